"""Scans, upserts and the other ways tables change.

Parquet has no MERGE: a changed table is a new version, written beside the old one.  All
functions return the new table.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.sources.schema import SCHEMAS


def scan_table(spark: SparkSession, path: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.schema(SCHEMAS[table]).parquet(path)
    return df.select(*columns) if columns else df


def key_ranges(keys: DataFrame, key: str, parts: int, error: float = 0.02) -> list[str]:
    """Conditions that cut a numeric key into ``parts`` of about as many rows, whatever its gaps and repeats; nulls go with the first."""
    cuts = keys.approxQuantile(key, [i / parts for i in range(1, parts)], error / parts)
    bounds = sorted({int(c) for c in cuts})
    if not bounds:
        return ["1 = 1"]
    first, last = f"{key} <= {bounds[0]} OR {key} IS NULL", f"{key} > {bounds[-1]}"
    return [first, *(f"{key} > {a} AND {key} <= {b}" for a, b in zip(bounds, bounds[1:], strict=False)), last]


def scan_all(spark: SparkSession, url: str, table: str, key: str, parts: int, columns: tuple[str, ...] = (), **options: str) -> DataFrame:
    """A whole database table, or some of its columns, in ``parts`` queries of about as many rows.

    The key alone is read first, in even ranges from its least to its greatest value, and its quantiles are the bounds, so that gaps
    and skew make no large part.  Each part is a condition on the key, which the database can answer by an index.
    """
    ends = spark.read.jdbc(url, f"(SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH FROM {table}) ENDS", properties=options).first()
    what = ", ".join(columns) if columns else "*"
    if ends[0] is None:
        return spark.read.jdbc(url, f"(SELECT {what} FROM {table}) ALL_ROWS", properties=options)
    keys = spark.read.jdbc(url, f"(SELECT {key} FROM {table}) ONLY_KEYS", column=key, lowerBound=int(ends[0]), upperBound=int(ends[1]) + 1, numPartitions=parts, properties=options)
    return spark.read.jdbc(url, f"(SELECT {what} FROM {table}) ALL_ROWS", predicates=key_ranges(keys, keys.columns[0], parts), properties=options)


def read_rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Feed files -> a row per item: doc_id, track_code (of the file's name), description, published."""
    items = spark.read.format("xml").option("rowTag", "item").schema("description string, pubDate string").load(path)
    name = F.col("_metadata.file_name")
    return items.select(F.xxhash64(F.col("_metadata.file_path"), "description").alias("doc_id"), F.regexp_extract(name, r"([A-Z]{2,3})", 1).alias("track_code"), "description", F.col("pubDate").alias("published"))


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    """A row per file: doc_id, track_code (of the file's name), html."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.regexp_extract(F.col("_metadata.file_name"), r"([A-Z]{2,3})", 1).alias("track_code"), F.col("value").alias("html"))


def read_text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of documents already cut to pages of text."""
    return spark.read.schema("doc_id string, page_no int, text string").parquet(path)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share, below ``spark.checkpoint.dir``; a local one only where all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` in the shared folder and reads it back, so that what reads it several times computes it once."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows replace old ones of their key; of several new rows of a key the greatest by ``order``,
    and by all columns.  Keys may be null, and null is a key."""
    rank = order or []
    rest = [c for c in new.columns if c not in rank]
    w = Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in (*rank, *rest)))
    newest = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("_rank", F.lit(0))
    both = old.withColumn("_rank", F.lit(1)).unionByName(newest, allowMissingColumns=True)
    return _latest(both, keys, F.col("_rank")).drop("_rank")


def upsert_nonnull(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Only what a new row has set replaces the old value."""
    n = new.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"_{c}") for c in new.columns if c not in keys))
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = test if on is None else on & test
    both = old.join(n, on, "full")
    return both.select(*(F.coalesce(f"_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns))


def fill_if_missing(old: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    n = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return old.join(n, key, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*(f"_{c}" for c in columns))


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(good, bad); an unknown is bad."""
    good = F.coalesce(valid, F.lit(False))
    return rows.where(good), rows.where(~good)


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column, **children: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """The table without the rows, and each child table (with its key) without what hangs on them."""
    gone = F.coalesce(condition, F.lit(False))
    out = {"": df.where(~gone)}
    for name, (child, key) in children.items():
        out[name] = child.join(df.where(gone).select(key).distinct(), key, "left_anti")
    return out


def get_or_create_dim(dim: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """``dim`` (key, name) with a row for each unseen name; keys follow from the names."""
    unseen = names.select(F.trim(name).alias(name)).where(F.col(name) != "").distinct().join(dim, name, "left_anti")
    made = unseen.select(F.sha2(F.upper(name), 256).cast(dim.schema[key].dataType).alias(key), name)
    return dim.select(key, name).unionByName(made)


def write_snapshot(df: DataFrame, path: str, key: str, captured_at: str) -> None:
    """Keeps a computed product under a key; later writes of the same instant replace it."""
    stamped = df.withColumns({"snapshot_key": F.lit(key), "captured_at": F.lit(captured_at).cast("timestamp")})
    stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_key", "captured_at").parquet(path)


def read_snapshot(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest rows of a key."""
    rows = spark.read.parquet(path).where(F.col("snapshot_key") == key)
    newest = rows.agg(F.max("captured_at").alias("captured_at"))
    return rows.join(newest, "captured_at", "left_semi")


def _place(spark: SparkSession, path: str):  # noqa: ANN202
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder, if it is there."""
    place, fs = _place(spark, path)
    fs.delete(place, True)


def subfolders(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern."""
    place, fs = _place(spark, pattern)
    return [f.getPath().toString() for f in fs.globStatus(place) or []]


def upload_state(events: DataFrame) -> DataFrame:
    """upload_id, status, logged_at: the latest of each upload."""
    last = F.struct("logged_at", "status")
    return events.groupBy("upload_id").agg(F.max(last).alias("last")).select("upload_id", "last.status", "last.logged_at")


def crawl_log(events: DataFrame, run_id: str) -> DataFrame:
    """A row for a run: counters and duration."""
    return events.agg(
        F.lit(run_id).alias("run_id"), F.min("seen_at").alias("started_at"), F.count("*").alias("requests"), F.count_if(F.col("kind") == "success").alias("succeeded"),
        F.count_if(F.col("kind") == "failure").alias("failed"), (F.unix_timestamp(F.max("seen_at")) - F.unix_timestamp(F.min("seen_at"))).alias("duration_seconds"),
    )
