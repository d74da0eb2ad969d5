"""Orders, pages and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from railbird.functions.names import change_identity, program_order
from railbird.sources.tables import written


def clamp(limit: int, most: int) -> int:
    return max(1, min(limit, most))


def paginate(df: DataFrame, order: list, page: int, limit: int) -> tuple[DataFrame, int, int, bool]:
    """(rows of the page, total, pages, whether more follow); ``order`` must be total."""
    total = df.count()
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    pages = -(-total // limit)
    return rows, total, pages, page < pages


RANGE_ROWS = 1_000_000  # rows of a range, about: what a task sorts


def _ranged(df: DataFrame, order: list, rows_per_range: int) -> DataFrame:
    """All rows with part and pos, from 1, in a total order: as many ranges as the rows need are sorted apart, and each counts on from those before it."""
    kept = written(df)
    ranges = max(1, -(-kept.count() // rows_per_range))
    # Written: the ranges come from samples, which differ when they are worked out again.  Rows are numbered as their range is sorted: the low 33 bits are the place in it.
    dealt = written(kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_own": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    before = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), "_part").withColumn("pos", (F.col("_before") + F.col("_own") + 1).cast("long")).drop("_own", "_before")


def numbered(df: DataFrame, order: list, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """All rows with pos, from 1, in a total order."""
    return _ranged(df, order, rows_per_range).drop("_part")


def page_export(df: DataFrame, order: list, limit: int, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """All rows with page, from 1, of ``limit`` rows each."""
    return numbered(df, order, rows_per_range).withColumn("page", (F.floor((F.col("pos") - 1) / limit) + 1).cast("long")).drop("pos")


def write_pages(df: DataFrame, order: list, path: str, rows_per_range: int = RANGE_ROWS) -> None:
    """A feed to read pages from: ``rows``, a folder of files for each range, and ``fences``, the first place and the rows of each."""
    ranged = _ranged(df, order, rows_per_range).withColumnRenamed("_part", "part")
    ranged.repartition("part").sortWithinPartitions("part", "pos").write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    ranged.drop("part").limit(0).write.mode("overwrite").parquet(f"{path}/schema")
    # Of the rows as written: one task that works the ranges out again would sort all of them.
    rows = df.sparkSession.read.schema("pos long, part int").parquet(f"{path}/rows")
    rows.groupBy("part").agg(F.min("pos").alias("first"), F.count("*").alias("rows")).repartition(1).write.mode("overwrite").parquet(f"{path}/fences")


def read_page(spark: SparkSession, path: str, page: int, limit: int) -> tuple[DataFrame, int, int, bool]:
    """(rows of the page in order, total, pages, whether more follow) of a feed that ``write_pages`` wrote: only files that hold the page are read."""
    fences = spark.read.parquet(f"{path}/fences")
    low, high = (page - 1) * limit + 1, page * limit
    total = fences.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    pages = -(-total // limit)
    hold = [r.part for r in fences.where((F.col("first") <= high) & (F.col("first") + F.col("rows") > low)).select("part").collect()]  # one, or the few that a page spans
    empty = spark.read.parquet(f"{path}/schema")
    if not hold:
        return empty, total, pages, page < pages
    rows = spark.read.schema(empty.schema).parquet(*(f"{path}/rows/part={p}" for p in hold)).where(F.col("pos").between(low, high))
    return rows.orderBy("pos"), total, pages, page < pages


def changes_order(descending: bool = False) -> list[Column]:
    keys = [F.col("race_date"), F.col("track_code"), F.col("race_number"), change_identity(F.col("program_number"), F.col("horse_name")), F.col("change_id"), F.col("source_rank")]
    return [k.desc() if descending else k.asc() for k in keys]


def sort_changes(feed: DataFrame, descending: bool = False) -> DataFrame:
    return feed.orderBy(*changes_order(descending))


def history_order() -> list[Column]:
    return [F.desc_nulls_last("race_date"), F.desc_nulls_last("race_number"), F.col("entry_id")]


def sort_history(df: DataFrame) -> DataFrame:
    return df.orderBy(*history_order())


def table_order(df: DataFrame, column: str, descending: bool = False, tie: str = "race_id") -> list[Column]:
    """As tables in a browser sort: texts by lower case with nulls as '', numbers by value, dates then by track and number."""
    kind = dict(df.dtypes)[column]
    key: Column = F.lower(F.coalesce(column, F.lit(""))) if kind == "string" else F.col(column)
    more = ["track_code", "race_number"] if kind == "date" else []
    return [key.desc_nulls_last() if descending else key.asc_nulls_first(), *map(F.col, more), F.col(tie)]


def sort_table(df: DataFrame, column: str, descending: bool = False, tie: str = "race_id") -> DataFrame:
    return df.orderBy(*table_order(df, column, descending, tie))


def sort_by(df: DataFrame, criteria: list[tuple[str, bool]]) -> DataFrame:
    """Columns with whether each falls."""
    return df.orderBy(*(F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in criteria))


def card_order() -> list[Column]:
    return [F.col("race_id"), F.asc_nulls_last("finish_position"), program_order(F.col("program_number")), F.col("program_number")]


def sort_card(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*card_order())


def pinned_order(pinned: str = "WO", tie: str = "track_code") -> list[Column]:
    return [F.col("track_code") != pinned, F.lower("track_name"), F.col(tie)]


def sort_pinned_first(tracks: DataFrame, pinned: str = "WO") -> DataFrame:
    return tracks.orderBy(*pinned_order(pinned))


def split_favourites(df: DataFrame, favourites: DataFrame, key: str, name: str) -> DataFrame:
    """Favourites first, each part by name."""
    marked = favourites.select(key).distinct().withColumn("is_favourite", F.lit(True))
    return df.join(marked, key, "left").withColumn("is_favourite", F.coalesce("is_favourite", F.lit(False))).orderBy(F.desc("is_favourite"), F.lower(name), key)


def recent(df: DataFrame, time: str, tie: str, limit: int) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(limit)
