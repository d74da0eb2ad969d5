"""Aggregations: all partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.money import win_pct


def _money(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("decimal(14,2)")


def race_stats(entries: DataFrame) -> DataFrame:
    """race_id, entry_count, top3: array of (finish_position, program_number, horse_id) in order."""
    place = F.when(F.col("finish_position") <= 3, F.struct("finish_position", "program_number", "horse_id"))
    return entries.groupBy("race_id").agg(F.count("*").alias("entry_count"), F.array_sort(F.collect_list(place)).alias("top3"))


def race_winner(races: DataFrame, entries: DataFrame) -> DataFrame:
    """race_id, winner_number, winner_horse_id: the stored number wins over the computed one; none: 'N/A'."""
    first = entries.where("finish_position = 1").groupBy("race_id").agg(F.min_by("program_number", "entry_id").alias("_n"), F.min_by("horse_id", "entry_id").alias("winner_horse_id"))
    return races.join(first, "race_id", "left").select("race_id", F.coalesce("winner_program_number", "_n", F.lit("N/A")).alias("winner_number"), "winner_horse_id")


def track_day_summary(races: DataFrame) -> DataFrame:
    """Per track and date: counts by state, next post time, winner of the last completed race.
    Needs live_status, winner_name, post_time, is_cancelled."""
    def state(name):  # noqa: ANN001, ANN202
        return F.count_if(F.col("live_status") == name)

    done = F.col("live_status") == "completed"
    return races.groupBy("track_code", "race_date").agg(
        F.count("*").alias("total"),
        state("upcoming").alias("upcoming"),
        state("past").alias("past_post"),
        state("completed").alias("completed"),
        F.count_if("is_cancelled").alias("cancelled"),
        F.bool_and("is_cancelled").alias("fully_cancelled"),
        F.min(F.when(F.col("live_status") == "upcoming", F.col("post_time"))).alias("next_post_time"),
        F.coalesce(F.max_by(F.when(done, F.coalesce("winner_name", F.lit("Unknown"))), F.when(done, F.col("race_number"))), F.lit("Unknown")).alias("last_winner"),
    )


def summary_total(summary: DataFrame) -> DataFrame:
    return summary.agg(F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("total"))


def horse_stats(starts: DataFrame) -> DataFrame:
    """Per horse over completed races, unscratched: starts, first three places, win %, last race.
    Needs horse_id, race_status, scratched, finish_position, race_date, track_code, race_number."""
    run = starts.where("race_status = 'completed' AND NOT coalesce(scratched, false)")
    out = run.groupBy("horse_id").agg(
        F.count("*").alias("starts"),
        *(F.count_if(F.col("finish_position") == i).alias(n) for i, n in enumerate(("wins", "places", "shows"), 1)),
        F.max("race_date").alias("last_race_date"),
        F.max_by("track_code", F.struct("race_date", "race_number", "track_code")).alias("last_track"),
    )
    return out.withColumn("win_pct", win_pct(F.col("wins"), F.col("starts")))


def horse_profile_stats(starts: DataFrame) -> DataFrame:
    """horse_stats with earnings: the payout of the place that was reached."""
    paid = (
        F.when(F.col("finish_position") == 1, F.col("win_payout")).when(F.col("finish_position") == 2, F.col("place_payout")).when(F.col("finish_position") == 3, F.col("show_payout"))
    )
    run = starts.where("race_status = 'completed' AND NOT coalesce(scratched, false)")
    return horse_stats(starts).join(run.groupBy("horse_id").agg(_money(paid).alias("earnings")), "horse_id")


def claims_coverage(claims: DataFrame) -> DataFrame:
    """How many claims name both trainer and owner; 100.0 % of none."""
    whole = (F.coalesce("new_trainer_name", F.lit("")) != "") & (F.coalesce("new_owner_name", F.lit("")) != "")
    out = claims.agg(F.count("*").alias("total"), F.count_if(whole).alias("complete"))
    return out.select(
        "total",
        "complete",
        (F.col("total") - F.col("complete")).alias("missing"),
        F.when(F.col("total") == 0, 100.0).otherwise(F.bround(F.col("complete") * 100.0 / F.col("total"), 1)).alias("coverage_pct"),
        (F.col("total") == F.col("complete")).alias("all_complete"),
    )


def bet_stats(bets: DataFrame) -> DataFrame:
    """Over resolved bets: rate of wins (whole %), wagered, paid, profit and return."""
    done = bets.where(~F.col("status").isin("Pending", "Returned", "Cancelled"))
    cost = F.coalesce(F.nullif("bet_cost", F.lit(0)), "bet_amount", F.lit(0))
    out = done.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "Win").alias("wins"), _money(cost).alias("wagered"), _money(F.coalesce("payout", F.lit(0))).alias("paid"))
    return out.select(
        "n",
        "wins",
        F.when(F.col("n") > 0, F.round(F.col("wins") * 100 / F.col("n"), 0).cast("int")).otherwise(0).alias("win_rate"),
        "wagered",
        "paid",
        (F.col("paid") - F.col("wagered")).cast("decimal(14,2)").alias("profit"),
        F.when(F.col("wagered") > 0, F.round((F.col("paid") - F.col("wagered")).cast("double") * 100 / F.col("wagered").cast("double"), 1)).otherwise(0.0).alias("roi_pct"),
    )


def new_earnings(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paid for bets that were pending and now are won."""
    was = before.where("status = 'Pending'").select("bet_id")
    return after.where("status = 'Win'").join(was, "bet_id", "left_semi").agg(_money(F.col("payout")).alias("earned"))


def distinct_dates(races: DataFrame, today: str) -> DataFrame:
    return races.where(F.col("race_date") <= F.lit(today).cast("date")).select("race_date").distinct()


def distinct_tracks(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """A name per code (of several, the greatest); ``overrides`` come on top."""
    fixed = df.sparkSession.createDataFrame(sorted(overrides.items()), "track_code string, fixed string")
    found = df.groupBy("track_code").agg(F.max("track_name").alias("track_name"))
    return found.join(fixed, "track_code", "full").select("track_code", F.coalesce("fixed", "track_name", "track_code").alias("track_name"))


def feed_metadata(feed: DataFrame, requested: str, applied: str) -> DataFrame:
    return feed.agg(F.min("race_date").alias("min_date"), F.max("race_date").alias("max_date"), F.count("*").alias("items")).select(
        "*", F.lit(requested).alias("requested_view"), F.lit(applied).alias("applied_view"), F.lit(requested != applied).alias("fallback_applied")
    )


def verified_races(races: DataFrame, entries: DataFrame) -> DataFrame:
    """race_id, finishers, has_winner, verified: completed, with a winner and three finishers."""
    seen = entries.groupBy("race_id").agg(F.count_if(F.col("finish_position") > 0).alias("finishers"), F.coalesce(F.bool_or(F.col("finish_position") == 1), F.lit(False)).alias("has_winner"))
    return races.join(seen, "race_id", "left").select(
        "race_id",
        F.coalesce("finishers", F.lit(0)).cast("long").alias("finishers"),
        F.coalesce("has_winner", F.lit(False)).alias("has_winner"),
        F.coalesce((F.col("race_status") == "completed") & F.col("has_winner") & (F.col("finishers") >= 3), F.lit(False)).alias("verified"),
    )


def recrawl_reason(verified: DataFrame) -> DataFrame:
    return verified.select("race_id", F.when(F.col("verified"), "verified_skip").when(F.col("has_winner"), "few_finishers").otherwise("no_winner").alias("reason"))


def run_stats(events: DataFrame, *by: str) -> DataFrame:
    """Attempts and outcomes of a crawl, by what is given."""
    return events.groupBy(*by).agg(
        F.count("*").alias("requested"),
        *(F.count_if(F.col("kind") == k).alias(n) for k, n in (("success", "succeeded"), ("failure", "failed"), ("signal", "signalled"))),
    )


def merge_run_stats(*runs: DataFrame) -> DataFrame:
    """Counters of several passes added, by feed."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    counters = [c for c in out.columns if c != "feed"]
    return out.groupBy("feed").agg(*(F.sum(c).alias(c) for c in counters))


def source_contributions(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("rows"))


def fetch_telemetry(events: DataFrame) -> DataFrame:
    return events.groupBy("source").agg(F.count("*").alias("attempts"), F.count_if(F.col("kind") == "success").alias("successes"))


def largest_candidate(candidates: DataFrame, key: str) -> DataFrame:
    """Of each key's variants (variant, size) that with most rows, the first of equals."""
    w = Window.partitionBy(key).orderBy(F.desc("size"), "variant")
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def race_map(parsed: DataFrame) -> DataFrame:
    """Of parsed races (doc_id, seq, race_number text, horses) those with a number and horses, the last of a number."""
    good = parsed.withColumn("race_number", F.expr("try_cast(race_number AS int)")).where("race_number IS NOT NULL AND size(horses) > 0")
    w = Window.partitionBy("doc_id", "race_number").orderBy(F.desc("seq"))
    return good.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending_refund_total(bets: DataFrame) -> DataFrame:
    return bets.where("status = 'Pending'").agg(_money(F.coalesce("bet_cost", F.lit(0))).alias("refund"))


def wallet_balance(ledger: DataFrame, opening: int = 1000) -> DataFrame:
    return ledger.groupBy("wallet_id").agg((F.lit(opening) + _money(F.col("amount"))).cast("decimal(14,2)").alias("balance"))


def running_balance(ledger: DataFrame, opening: int = 1000) -> DataFrame:
    """Balance after each movement of a wallet; movements at one time go by reference.  A wallet's movements are cut by the day, and carried on by totals."""
    from railbird.operators.dedupe import running

    moved = running(ledger, ("wallet_id",), F.date_trunc("DAY", "at"), ["at", "reference_id", "transaction_type"], _moved=("sum", F.col("amount")))
    return moved.withColumn("balance", (F.lit(opening) + F.col("_moved")).cast("decimal(14,2)")).drop("_moved")


def activity_probe(entries: DataFrame, races: DataFrame, today: str) -> DataFrame:
    """Whether there are entries from today to in two days, and results or scratches of yesterday or today."""
    day = F.lit(today).cast("date")
    near = entries.join(races.select("race_id", "race_date"), "race_id").where(F.col("race_date").between(F.date_sub(day, 1), F.date_add(day, 2)))
    return near.agg(
        F.coalesce(F.bool_or(F.col("race_date") >= day), F.lit(False)).alias("has_entries"),
        F.coalesce(F.bool_or((F.col("race_date") <= day) & (F.col("finish_position") <= 3)), F.lit(False)).alias("has_results"),
        F.coalesce(F.bool_or((F.col("race_date") <= day) & F.col("scratched")), F.lit(False)).alias("has_scratches"),
    )
