"""Row shapes of feeds and lists, with their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.times import format_12h


def _or(column: str, default: str):  # noqa: ANN202
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias(column)


def shape_change(feed: DataFrame) -> DataFrame:
    return feed.select("change_id", "race_id", "race_key", "race_date", "track_code", _or("track_name", "N/A"), "race_number", format_12h(F.coalesce("post_time", F.lit("N/A"))).alias("post_time"),
                       "entry_id", _or("program_number", "-"), _or("horse_name", "Race-wide"), "change_type", F.coalesce("description", F.lit("")).alias("description"), "change_time", "source_rank")


def shape_scratch(feed: DataFrame) -> DataFrame:
    return feed.select(F.coalesce("entry_id", "change_id").alias("id"), "race_key", "race_date", "track_code", "race_number", "post_time", "program_number", "horse_name", F.lit("Scratched").alias("status"), "description")


def shape_race(races: DataFrame) -> DataFrame:
    return races.select("race_id", "race_key", "track_code", F.coalesce("track_name", "track_code").alias("track_name"), "race_date", "race_number", format_12h(F.coalesce("post_time", F.lit("N/A"))).alias("post_time"),
                        "race_type", "surface", "distance", "purse", "live_status", F.coalesce("entry_count", F.lit(0)).cast("long").alias("entry_count"),
                        F.coalesce(F.array_join(F.transform("top3", lambda x: x["program_number"]), "-"), F.lit("")).alias("results"), F.coalesce("has_claims", F.lit(False)).alias("has_claims"))


def shape_entry(entries: DataFrame) -> DataFrame:
    info = F.struct(F.coalesce("horse_name", F.lit("Unknown")).alias("horse_name"), F.coalesce(F.col("foaling_year").cast("string"), F.lit("N/A")).alias("foaling_year"))
    return entries.select("race_id", "entry_id", "program_number", info.alias("horse_info"), F.coalesce("jockey_name", F.lit("N/A")).alias("jockey_name"), F.coalesce("scratched", F.lit(False)).alias("scratched"), "finish_position")


def shape_claim(claims: DataFrame) -> DataFrame:
    whole = (F.coalesce("new_trainer_name", F.lit("")) != "") & (F.coalesce("new_owner_name", F.lit("")) != "")
    return claims.select("claim_id", "race_key", "race_date", "track_code", "race_number", "program_number", _or("new_trainer_name", "N/A"), _or("new_owner_name", "N/A"), "claim_price", whole.alias("claimant_details_complete"))


def shape_history(starts: DataFrame) -> DataFrame:
    return starts.select("horse_id", "entry_id", "race_key", "race_date", "track_code", "race_number", "program_number", F.coalesce(F.col("finish_position").cast("string"), F.lit("N/A")).alias("finish"), F.coalesce("win_payout", F.lit(0)).alias("win_payout"))


def annotate_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.lit(source))
