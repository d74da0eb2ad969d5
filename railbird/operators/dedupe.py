"""Windows within small keys: deduplication, carried values, neighbours, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.changes import change_type_class
from railbird.functions.names import change_identity, normalize_name, space_count
from railbird.sources.tables import written


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_changes(feed: DataFrame) -> DataFrame:
    """One row per event, the latest; race-wide events differ by the start of their text.
    Ties go to changes before entries (source_rank), then to the lesser change_id."""
    kind = change_type_class(F.col("change_type"), F.col("description"))
    who = change_identity(F.col("program_number"), F.col("horse_name"))
    said = F.when(F.col("_who") == "RACE_WIDE", F.lower(F.substring(F.trim(F.coalesce("description", F.lit(""))), 1, 30))).otherwise("")
    keyed = feed.withColumn("_class", kind).withColumn("_who", who).withColumn("_said", said)
    latest = first_by(keyed, [F.upper(F.trim("track_code")), "race_date", "race_number", "_who", "_class", "_said"], [F.desc_nulls_last("change_time"), "source_rank", "change_id"])
    relabelled = F.when((F.col("_class") == "scratch") & (F.col("change_type") == "Other"), "Scratch").otherwise(F.col("change_type"))
    return latest.withColumn("change_type", relabelled).drop("_class", "_who", "_said")


def merge_descriptions(changes: DataFrame, most: int = 500, keys: tuple[str, ...] = ("race_id", "entry_id", "change_type")) -> DataFrame:
    """race_id, entry_id, change_type (or other ``keys``), description: texts of a change in order.  A reason beats
    'Reason Unavailable'; a text that is already said adds nothing; long ones end in dots."""
    lists = changes.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", F.coalesce("description", F.lit("")).alias("text")))).alias("all"))

    def add(now: Column, item: Column) -> Column:
        new = item["text"]
        vague = lambda x: F.lower(x).contains("reason unavailable")
        return (
            F.when((new == "") | F.lower(now).contains(F.lower(new)), now)
            .when((now == "") | (vague(now) & ~vague(new)), new)
            .when(vague(new), now)
            .otherwise(F.concat(now, F.lit("; "), new))
        )

    merged = F.aggregate("all", F.lit(""), add)
    return lists.select(*keys, F.when(F.length(merged) > most, F.concat(F.substring(merged, 1, most - 3), F.lit("..."))).otherwise(merged).alias("description"))


def dedupe_entries_by_horse(entries: DataFrame) -> DataFrame:
    """One entry per horse name in a race; one with a finish position before others, then the first."""
    return first_by(entries, ["race_id", F.upper("horse_name")], [F.col("finish_position").isNull(), "entry_id"])


def best_display_name(df: DataFrame, key: str = "race_id") -> DataFrame:
    """Per key and normalised name, the spelling with most spaces."""
    return df.groupBy(key, normalize_name(F.col("horse_name")).alias("norm_name")).agg(F.max(F.struct(space_count(F.col("horse_name")).alias("spaces"), "horse_name"))["horse_name"].alias("display_name"))


def prefer_detail_entries(entries: DataFrame) -> DataFrame:
    """Entries of continuation pages over those of header pages, by program number; the last wins."""
    return first_by(entries, ["race_id", "program_number"], [F.desc("is_detail"), F.desc("page_no"), F.desc("line_no")])


def dedupe_ordered(codes: DataFrame) -> DataFrame:
    """Distinct codes, trimmed and upper-case, with the place where each is first seen."""
    return codes.select(F.upper(F.trim("track_code")).alias("track_code"), "pos").where("track_code <> ''").groupBy("track_code").agg(F.min("pos").alias("pos"))


def prev_next_race(races: DataFrame) -> DataFrame:
    card = Window.partitionBy("track_code", "race_date").orderBy("race_number")
    return races.withColumn("prev_race_key", F.lag("race_key").over(card)).withColumn("next_race_key", F.lead("race_key").over(card))


def top_finishers(entries: DataFrame, places: int = 3) -> DataFrame:
    return entries.where(F.col("finish_position").between(1, places))


def page_segments(pages: DataFrame, is_header: Column) -> DataFrame:
    """Adds segment: pages belong to the last header page before them; those before the first are segment 0."""
    order = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return pages.withColumn("segment", F.sum(F.coalesce(is_header, F.lit(False)).cast("int")).over(order))


def carry_forward(lines: DataFrame, *columns: str, order: str = "line_no", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Nulls take the last value above them in the document."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def implicit_first_segment(segments: DataFrame) -> DataFrame:
    """What stands before the first header is race 1."""
    return segments.withColumn("race_number", F.coalesce("race_number", F.lit(1)))


def finish_by_order(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",), order: str = "line_no") -> DataFrame:
    return rows.withColumn("finish_position", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def first_non_empty_source(rows: DataFrame, key: str = "track_code") -> DataFrame:
    """Of each key only the rows of its first source (priority) that has any."""
    best = rows.groupBy(key).agg(F.min("priority").alias("priority"))
    return rows.join(best, [key, "priority"], "left_semi")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("snapshot_key").agg(F.max_by("payload", F.struct("captured_at", "payload")).alias("payload"), F.max("captured_at").alias("captured_at"))


def running(rows: DataFrame, keys: tuple[str, ...], bucket: Column, order: list, **values: tuple[str, Column]) -> DataFrame:
    """Adds running sums or maxima, (``"sum"`` or ``"max"``, column) by name, over each key in ``order``.

    A key's rows are cut by ``bucket``, which must not fall as the order rises; totals of the buckets before,
    a row for each, carry on.  So a key with a third of all rows is many windows.  The rows are written once.
    """
    how = {"sum": F.sum, "max": F.max}
    own = [*keys, "_bucket"]
    at = written(rows.withColumn("_bucket", bucket).withColumns({f"_v_{n}": c for n, (_, c) in values.items()}))
    totals = at.groupBy(*own).agg(*(how[f](f"_v_{n}").alias(f"_t_{n}") for n, (f, _) in values.items()))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*(F.col(k).alias(f"_k_{k}") for k in own), *(how[f](f"_t_{n}").over(earlier).alias(f"_b_{n}") for n, (f, _) in values.items()))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in own]
    within = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(before, on)
    for n, (f, _) in values.items():
        here = how[f](f"_v_{n}").over(within)
        out = out.withColumn(n, F.coalesce(here, F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0)) if f == "sum" else F.greatest(here, f"_b_{n}"))
    return out.select(*rows.columns, *values)


def consecutive_runs(states: DataFrame, keys: tuple[str, ...], order: str, flag: str, bucket: Column | None = None) -> DataFrame:
    """Adds run: how many rows in a row, up to this one, have ``flag``; 0 where it is false.  ``bucket`` as in ``running``."""
    part = F.lit(0) if bucket is None else bucket
    counted = running(states.withColumn("_part", part), keys, F.col("_part"), [order], _seen=("sum", F.col(flag).cast("long")))
    reset = running(counted, keys, F.col("_part"), [order], _base=("max", F.when(~F.col(flag), F.col("_seen"))))
    return reset.withColumn("run", F.when(F.col(flag), F.col("_seen") - F.coalesce("_base", F.lit(0))).otherwise(0)).drop("_seen", "_base", "_part")
