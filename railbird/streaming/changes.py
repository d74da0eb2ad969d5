"""Late changes and results as streams, and what they do to races and entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.changes import extract_new_post_time, valid_cancellation
from railbird.operators.extract import extract_rss_changes
from railbird.operators.joins import match_entries, zombie_entries
from railbird.operators.ordering import numbered
from railbird.sources.tables import upsert


def late_change_filter(docs: DataFrame, day: str, watermark: str = "1 day") -> DataFrame:
    """Documents (published_ts) of the day; on a stream, later ones than the watermark go."""
    return docs.withWatermark("published_ts", watermark).where(F.to_date("published_ts") == F.lit(day).cast("date"))


def stream_dedupe(changes: DataFrame, keys: list[str], watermark_column: str = "published_ts", watermark: str = "1 day") -> DataFrame:
    """The same event of several sources once: of a table the first by time and all columns, of a stream the first to come within the watermark."""
    if changes.isStreaming:
        return changes.withColumn(watermark_column, F.col(watermark_column).cast("timestamp")).withWatermark(watermark_column, watermark).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in changes.columns if c not in keys]
    first = F.struct(*([watermark_column] if watermark_column in rest else []), *(c for c in rest if c != watermark_column))
    one = changes.groupBy(*keys).agg(F.min(first).alias("_first")).select(*keys, "_first.*")
    return one.select(*changes.columns)


def apply_scratches(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds scratch_effect (marked, confirmed, null) and sets scratched where a Scratch change names the entry."""
    named = changes.where("change_type = 'Scratch' AND entry_id IS NOT NULL").select("entry_id").distinct().withColumn("_s", F.lit(True))
    out = entries.join(named, "entry_id", "left")
    effect = F.when(F.col("_s") & ~F.coalesce("scratched", F.lit(False)), "marked").when(F.col("_s"), "confirmed")
    return out.withColumn("scratch_effect", effect).withColumn("scratched", F.coalesce("_s", "scratched", F.lit(False))).drop("_s")


def apply_cancellations(races: DataFrame, changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Flag and reason are always set; the status only of races without results."""
    told = changes.where(F.col("change_type") == "Race Cancelled").where(valid_cancellation(F.concat_ws(" ", "change_type", "description"))).groupBy("race_id").agg(F.min("description").alias("_why"))
    results = entries.where("finish_position IS NOT NULL").select("race_id").distinct().withColumn("_results", F.lit(True))
    out = races.join(told, "race_id", "left").join(results, "race_id", "left")
    hit = F.col("_why").isNotNull()
    stays = (F.col("race_status") == "completed") | F.coalesce("_results", F.lit(False))
    return out.withColumns(
        {"is_cancelled": hit | F.coalesce("is_cancelled", F.lit(False)), "cancellation_reason": F.coalesce("_why", "cancellation_reason"), "race_status": F.when(hit & ~stays, "cancelled").otherwise(F.col("race_status"))}
    ).drop("_why", "_results")


def apply_delays(races: DataFrame, changes: DataFrame) -> DataFrame:
    """Races with a post time change are delayed, and have the new time where one is given; the last change counts."""
    told = changes.where("change_type = 'Post Time Change'").groupBy("race_id").agg(F.max_by("description", F.struct("created_at", "change_id")).alias("_said"))
    out = races.join(told, "race_id", "left")
    hit = F.col("_said").isNotNull() & ~F.col("race_status").isin("completed", "cancelled")
    return out.withColumns({"post_time": F.when(hit, F.coalesce(extract_new_post_time(F.col("_said")), F.col("post_time"))).otherwise(F.col("post_time")), "race_status": F.when(hit, "delayed").otherwise(F.col("race_status"))}).drop("_said")


def apply_results(races: DataFrame, entries: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(races, entries) after ``results`` (race_id, program_number, finish_position): races with results are
    completed, entries in them have their place and run, and entries missing from three or more are scratched."""
    done = results.select("race_id").distinct().withColumn("_done", F.lit(True))
    r = races.join(done, "race_id", "left").withColumn("race_status", F.when(F.col("_done"), "completed").otherwise(F.col("race_status"))).drop("_done")
    gone = zombie_entries(entries, results).select("entry_id").withColumn("_gone", F.lit(True))
    placed = results.select("race_id", "program_number", F.col("finish_position").alias("_place"), F.lit(True).alias("_ran"))
    e = entries.join(placed, ["race_id", "program_number"], "left").join(gone, "entry_id", "left")
    e = e.withColumns(
        {
            "finish_position": F.when(F.col("_gone"), None).otherwise(F.coalesce("_place", "finish_position")),
            "scratched": F.when(F.col("_gone"), True).when(F.col("_ran"), False).otherwise(F.coalesce("scratched", F.lit(False))),
        }
    ).drop("_place", "_ran", "_gone")
    return r, e.select(*entries.columns)


def reset_races(races: DataFrame, entries: DataFrame, changes: DataFrame, race_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undoes results, scratches and changes of the races."""
    mark = race_ids.select("race_id").distinct().withColumn("_x", F.lit(True))
    r = races.join(mark, "race_id", "left").withColumn("race_status", F.when(F.col("_x"), "upcoming").otherwise(F.col("race_status"))).drop("_x")
    e = entries.join(mark, "race_id", "left").withColumns({"finish_position": F.when(F.col("_x"), None).otherwise(F.col("finish_position")), "scratched": F.when(F.col("_x"), False).otherwise(F.col("scratched"))}).drop("_x")
    return r, e, changes.join(mark, "race_id", "left_anti")


def group_changes_by_track(changes: DataFrame) -> DataFrame:
    """``changes`` with place: where each stands among its track's changes of a run, in the order they were read (doc_id, line_no)."""
    placed = numbered(changes, ["track_code", "doc_id", "line_no"])
    first = placed.groupBy("track_code").agg(F.min("pos").alias("_first"))
    return placed.join(first.withColumnRenamed("track_code", "_track"), placed.track_code.eqNullSafe(F.col("_track"))).withColumn("place", F.col("pos") - F.col("_first") + 1).drop("pos", "_first", "_track")


def ingest_changes(stored: DataFrame, items: DataFrame, races: DataFrame, entries: DataFrame, day: str) -> DataFrame:
    """``stored`` changes with those of feed ``items`` (doc_id, track_code, description) of a day added.

    A line is matched to the race by track, day and number, and to an entry by program number, else by name; what
    fits no race, and a horse that the race doesn't have, is left out.  The key is race, entry and kind: the same
    item again changes nothing, a later text of the same change takes the place of the earlier one.
    """
    today = races.where(F.col("race_date") == F.lit(day).cast("date")).select("race_id", "track_code", "race_number")
    found = extract_rss_changes(items).join(today, ["track_code", "race_number"])
    named = found.withColumn("horse_name", F.nullif("horse_name", F.lit("")))
    here = entries.join(today.select("race_id"), "race_id", "left_semi")
    matched = match_entries(named, here).select("race_id", "entry_id", "change_type", "description", "doc_id", "line_no")
    new = matched.groupBy("race_id", "entry_id", "change_type").agg(F.max_by("description", F.struct("doc_id", "line_no", "description")).alias("description"))
    return upsert(stored, new, ["race_id", "entry_id", "change_type"])


def stream_changes(docs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None):
    """Landed feed documents (doc_id, track_code, description) -> changes, handed to ``sink`` (rows, batch id) batch by
    batch.  A batch may come again after a failure: sinks are to be idempotent by batch id or key."""
    return extract_rss_changes(docs).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()
