"""Unions and differences of feeds, days and tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of a change in a feed.
FEED = ("change_id", "race_id", "entry_id", "program_number", "change_type", "description", "change_time", "source_rank")


def union_change_sources(changes: DataFrame, scratched_entries: DataFrame) -> DataFrame:
    """Told changes (source_rank 0) and entries that are only flagged as scratched (1)."""
    told = changes.select("change_id", "race_id", "entry_id", "program_number", "change_type", "description", F.col("created_at").alias("change_time"), F.lit(0).alias("source_rank"))
    flagged = scratched_entries.select(
        F.col("entry_id").alias("change_id"), "race_id", "entry_id", "program_number", F.lit("Scratch").alias("change_type"), F.lit("Scratched").alias("description"),
        F.lit(None).cast("timestamp").alias("change_time"), F.lit(1).alias("source_rank"),
    )
    return told.unionByName(flagged)


def union_feeds(**feeds: DataFrame) -> DataFrame:
    """Rows of several sources, with the source's name; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(name)) for name, df in feeds.items()))


def union_days(df: DataFrame, day: str, before: int = 0, after: int = 0, column: str = "race_date") -> DataFrame:
    d = F.lit(day).cast("date")
    return df.where(F.col(column).between(F.date_sub(d, before), F.date_add(d, after)))


def union_distinct_tracks(*sides: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, (s.select("track_code") for s in sides)).distinct()


def except_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("track_code").subtract(b.select("track_code"))


def intersect_tracks(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("track_code").intersect(b.select("track_code"))
