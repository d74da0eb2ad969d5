"""Late changes of many days into tables of changes, entries and races, batch by batch.

A store is a folder of tables, each cut by day and version.  A batch reads the committed version of the days
that its items are of, writes those days anew under the next version, one table after the other, and commits last.
Of entries only the first version has all; later ones have the ids of those that the feed has scratched, which a reader marks.
So what a batch writes grows with its days and not with the tables, readers see all tables before or after a
batch, and a batch that failed between two tables starts from where it started before.  A batch that was committed
and comes again is known by the stream's id and its number.  A store has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.functions import times
from railbird.functions.changes import extract_new_post_time
from railbird.operators.dedupe import merge_descriptions
from railbird.operators.extract import extract_rss_changes
from railbird.operators.joins import match_entries
from railbird.sources.tables import remove, subfolders

TABLES = ("changes", "entries", "races")
HORSE_TYPES = ("Scratch", "Jockey Change", "Weight Change", "Equipment Change")  # nothing without their horse
CHANGES = "race_id long, entry_id long, change_type string, description string, race_date date"


def stream_rss_items(spark: SparkSession, path: str, archive: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A folder of feed files that land -> doc_id, track_code (of the file's name), description, published, race_date, broken.

    Items are of the day of their pubDate in its own zone, without one of the day their file landed; with one that can't be
    read they are of no day.  A file that doesn't end, or an item that is no XML, is one row with its text in ``broken``.  Files that are done
    move to ``archive``.
    """
    options = {"wholetext": "true", "maxFilesPerTrigger": str(files_per_batch)}
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": archive}
    files = spark.readStream.format("text").options(**options).load(path)
    return rss_items(files.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("landed_at")))


def rss_items(files: DataFrame) -> DataFrame:
    """(value, path, name, landed_at) -> rows as ``stream_rss_items`` has them, of a table or a stream."""
    ends = F.col("value").rlike(r"</(rss|feed|rdf:RDF)\s*>\s*\z")
    found = F.when(ends, F.regexp_extract_all("value", F.lit(r"(?s)<item\b.*?</item\s*>"), F.lit(0))).otherwise(F.array(F.lit(None).cast("string")))
    each = files.select("path", "name", "landed_at", F.when(~ends, F.col("value")).alias("file"), F.explode(found).alias("item"))
    shape = "description string, pubDate string, _corrupt_record string"
    parsed = each.withColumn("x", F.from_xml("item", F.lit(shape), {"columnNameOfCorruptRecord": "_corrupt_record"}))
    broken = F.coalesce("file", F.when(F.col("x._corrupt_record").isNotNull() | F.col("x").isNull(), F.col("item")))
    day = F.when(F.col("x.pubDate").isNull(), F.to_date("landed_at")).otherwise(times.parse_rfc822_date(F.col("x.pubDate")))
    return parsed.select(
        F.xxhash64("path", F.coalesce("item", "file")).alias("doc_id"), F.regexp_extract("name", r"([A-Z]{2,3})", 1).alias("track_code"), F.col("x.description").alias("description"), F.col("x.pubDate").alias("published"),
        F.when(broken.isNull(), day).alias("race_date"), broken.alias("broken"),
    )


def match_items(items: DataFrame, races: DataFrame, entries: DataFrame) -> DataFrame:
    """Feed items (doc_id, track_code, description, race_date, published) -> race_date, race_id, entry_id, change_type, description, seq.

    A line is of the race with its track, day and number, and of the entry with its program number, else its name.  What
    fits no race is left out, and a scratch, jockey, weight or equipment without its horse; other notes of an unknown horse are the race's.  ``seq`` is
    the order in which items count: as they were published, then by document and line.
    """
    once = items.where("race_date IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("_at", times.rfc822_instant(F.col("published")))
    found = extract_rss_changes(once, ("doc_id", "track_code", "race_date", "_at")).join(races.select("race_id", "track_code", "race_date", "race_number"), ["track_code", "race_date", "race_number"])
    named = found.withColumn("horse_name", F.nullif("horse_name", F.lit("")))
    matched = match_entries(named, entries, keep=~F.col("change_type").isin(*HORSE_TYPES))
    return matched.select("race_date", "race_id", "entry_id", "change_type", "description", F.struct(F.lit(1).alias("new"), "_at", "doc_id", "line_no").alias("seq"))


def apply_items(items: DataFrame, changes: DataFrame, entries: DataFrame, races: DataFrame) -> dict[str, DataFrame]:
    """The three tables after some feed items.

    Changes of one race, entry and kind become one, texts in their order.  Scratches mark entries.  A cancellation flags
    its race and is its status, unless the race has run; a new post time delays it; of both the later one counts.
    """
    new = match_items(items, races, entries)
    gone = scratched_ids(new).select("entry_id", F.lit(True).alias("_gone"))
    marked = entries.join(gone, "entry_id", "left").withColumn("scratched", F.coalesce("_gone", "scratched", F.lit(False))).select(*entries.columns)
    return {"changes": apply_to_changes(new, changes), "entries": marked, "races": apply_to_races(new, entries, races)}


def scratched_ids(new: DataFrame) -> DataFrame:
    """race_date, entry_id of entries that some matched items scratch."""
    return new.where("change_type = 'Scratch' AND entry_id IS NOT NULL").select("race_date", "entry_id").dropDuplicates(["entry_id"])


def apply_to_changes(new: DataFrame, changes: DataFrame) -> DataFrame:
    """``changes`` with some matched items.  Dealt by day, as it is written."""
    kinds = new.schema["seq"].dataType
    stored = changes.withColumn("seq", F.struct(F.lit(0).alias("new"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds.fields[1:])))
    columns = ["race_date", "race_id", "entry_id", "change_type", "description", "seq"]
    both = stored.select(*columns).unionByName(new.select(*columns)).repartition("race_date")
    return merge_descriptions(both, keys=("race_date", "race_id", "entry_id", "change_type")).select(*changes.columns)


def apply_to_races(new: DataFrame, entries: DataFrame, races: DataFrame) -> DataFrame:
    """``races`` with some matched items.  Dealt by day, as it is written; what is told of a race comes to it there, so that whole races are shuffled once."""
    off, late = F.col("change_type") == "Race Cancelled", F.col("change_type") == "Post Time Change"
    told = new.where(off | late).groupBy("race_date", "race_id").agg(
        F.max(F.when(off, F.col("seq"))).alias("_off"), F.max_by(F.when(off, F.col("description")), F.when(off, F.col("seq"))).alias("_why"),
        F.max(F.when(late, F.col("seq"))).alias("_late"), F.min(F.when(late, F.col("seq"))).alias("_first"),
        F.max_by(extract_new_post_time(F.col("description")), F.when(late & extract_new_post_time(F.col("description")).isNotNull(), F.col("seq"))).alias("_time"),
    )
    ran = entries.where("finish_position IN (1, 2, 3)").select("race_id").distinct().withColumn("_ran", F.lit(True))
    about = told.join(ran, "race_id", "left").select("race_date", "race_id", F.struct("_off", "_why", "_late", "_first", "_time", "_ran").alias("_told"))
    rows = races.select("race_date", "race_id", F.struct(*races.columns).alias("_race"))
    race = Window.partitionBy("race_date", "race_id")
    met = rows.unionByName(about, allowMissingColumns=True).repartition("race_date").withColumn("_told", F.first("_told", ignorenulls=True).over(race))
    both = met.where("_race IS NOT NULL").select("_race.*", "_told.*")
    # A completed race that was delayed since isn't complete any more.
    stops = F.col("_off").isNotNull() & F.col("_ran").isNull() & F.coalesce((F.col("race_status") != "completed") | (F.col("_off") > F.col("_first")), F.lit(False))
    status = F.when(stops & F.coalesce(F.col("_off") > F.col("_late"), F.lit(True)), "cancelled").when(F.col("_late").isNotNull(), "delayed").otherwise(F.col("race_status"))
    return both.withColumns({
        "race_status": status, "post_time": F.coalesce("_time", "post_time"), "is_cancelled": F.col("_off").isNotNull() | F.coalesce("is_cancelled", F.lit(False)), "cancellation_reason": F.coalesce("_why", "cancellation_reason"),
    }).select(*races.columns)


# --- the store -------------------------------------------------------------------------------


def _write_days(df: DataFrame, folder: str, table: str, version: int) -> None:
    # A file for each day, which is what one day of racing is.
    df.withColumn("v", F.lit(version)).repartition("race_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("race_date", "v").parquet(f"{folder}/{table}")


def _last_commit(spark: SparkSession, folder: str) -> tuple[int, str, int]:
    """(version, stream's id, batch) of the last commit."""
    row = spark.read.schema("stream string, batch long, v long").parquet(f"{folder}/commits").orderBy(F.desc("v")).first()
    return row.v, row.stream, row.batch


def _commit(spark: SparkSession, folder: str, version: int, stream: str, batch: int) -> None:
    """One file of one row, which is there or not."""
    spark.createDataFrame([(stream, batch)], "stream string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/v={version}")


def create_store(folder: str, races: DataFrame, entries: DataFrame, changes: DataFrame | None = None) -> None:
    """Version 0 of a store: ``races`` (race_id, race_date, track_code, race_number, race_status, post_time, is_cancelled, cancellation_reason, …),
    ``entries`` (entry_id, race_id, race_date, program_number, horse_name, scratched, finish_position, …), ``changes`` (race_id, entry_id, change_type, description, race_date)."""
    spark = races.sparkSession
    tables = {"changes": spark.createDataFrame([], CHANGES) if changes is None else changes, "entries": entries, "races": races}
    for name, df in tables.items():
        df.limit(0).write.mode("overwrite").parquet(f"{folder}/_schema/{name}")
        _write_days(df, folder, name, 0)
    _commit(spark, folder, 0, "", -1)


def _stored(spark: SparkSession, folder: str, table: str, low: int, high: int, days: Iterable | None) -> DataFrame:
    """Rows of the newest version, of ``low`` to ``high``, of each day, of some days or all."""
    schema = spark.read.parquet(f"{folder}/_schema/{table}").schema
    rows = spark.read.schema(schema.add("v", "integer")).parquet(f"{folder}/{table}").where(F.col("v").between(low, high))
    if days is not None:
        rows = rows.where(F.col("race_date").isin(*days))
    if low < high:
        newest = rows.groupBy("race_date").agg(F.max("v").alias("v"))  # a row per day
        rows = rows.join(newest, ["race_date", "v"], "left_semi")
    return rows.select(*(c for c in schema.names if c != "v"))


def read_store(spark: SparkSession, folder: str, table: str, days: Iterable | None = None) -> DataFrame:
    """A table of a store as of its last commit, of some days or all."""
    version = _last_commit(spark, folder)[0]
    if table != "entries":
        return _stored(spark, folder, table, 0, version, days)
    entries = _stored(spark, folder, table, 0, 0, days)
    if not version:
        return entries
    gone = _stored(spark, folder, table, 1, version, days).select("entry_id").distinct().withColumn("_gone", F.lit(True))
    return entries.join(gone, "entry_id", "left").withColumn("scratched", F.coalesce("_gone", "scratched", F.lit(False))).select(*entries.columns)


def _sweep(spark: SparkSession, folder: str, days: Iterable, version: int) -> None:
    """Removes all but the last two versions of the days, and the first of entries: readers may still be at the one before."""
    touched = {str(d) for d in days}
    for table in TABLES:
        versions: dict[str, list[int]] = {}
        for path in subfolders(spark, f"{folder}/{table}/race_date=*/v=*"):
            day, v = path.rsplit("/race_date=", 1)[1].split("/v=")
            if day in touched and (table != "entries" or int(v)):
                versions.setdefault(day, []).append(int(v))
        for day, known in versions.items():
            for v in sorted(known)[:-2]:
                remove(spark, f"{folder}/{table}/race_date={day}/v={v}")
    remove(spark, f"{folder}/commits/v={version - 2}")


def apply_batch(items: DataFrame, folder: str, stream: str, batch: int) -> None:
    """Items of one batch into the store, once, however often it comes.  Broken ones go to the folder's ``quarantine``."""
    spark = items.sparkSession
    version, last_stream, last_batch = _last_commit(spark, folder)
    if (stream, batch) == (last_stream, last_batch):
        return
    version += 1
    for table in TABLES:  # of an attempt that came to no commit
        for path in subfolders(spark, f"{folder}/{table}/race_date=*/v={version}"):
            remove(spark, path)
    items = items.persist()
    try:
        if "broken" in items.columns:
            items.where("broken IS NOT NULL").select("doc_id", "track_code", "broken").write.mode("overwrite").parquet(f"{folder}/quarantine/v={version}")
            items_ok = items.where("broken IS NULL")
        else:
            items_ok = items
        days = [r.race_date for r in items_ok.select("race_date").where("race_date IS NOT NULL").distinct().collect()]  # calendar days
        if days:
            changes, races = (_stored(spark, folder, t, 0, version - 1, days) for t in ("changes", "races"))
            entries, gone = _stored(spark, folder, "entries", 0, 0, days), _stored(spark, folder, "entries", 1, version - 1, days)
            # Written and not cached: a write to a table drops what is cached of it.
            matched = match_items(items_ok, races, entries)
            matched.write.mode("overwrite").parquet(f"{folder}/_matched")
            new = spark.read.schema(matched.schema).parquet(f"{folder}/_matched")
            ids = gone.select("race_date", "entry_id").unionByName(scratched_ids(new)).distinct()
            for table, rows in (("changes", apply_to_changes(new, changes)), ("entries", ids), ("races", apply_to_races(new, entries, races))):
                _write_days(rows, folder, table, version)
        _commit(spark, folder, version, stream, batch)
        _sweep(spark, folder, days, version)
    finally:
        items.unpersist()
        remove(spark, f"{folder}/_matched")


def stream_ingest(items: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None):
    """A stream of feed items (doc_id, track_code, description, published, race_date) into a store."""

    def each(rows: DataFrame, n: int) -> None:
        stream = json.loads(rows.sparkSession.read.text(f"{checkpoint}/metadata").first().value)["id"]
        apply_batch(rows, folder, stream, n)

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 minutes"})).start()
