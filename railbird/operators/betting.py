"""Cost, validation and settlement of bets.  A selection is JSON: a list, or a list per position."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.money import MONEY, key_combos, perm2, perm3, scale_payout
from railbird.sources.tables import written

SINGLE = ("Win", "Place", "Show", "Win Place", "Place Show", "WPS", "Win Place Show")
BOXES = ("Exacta Box", "Trifecta Box")
GROUPS_OF_BATCH = 10_000
NOTHING = np.zeros(1, np.int64)  # of a function without bets, which leaves all funds


def parse_selection(bets: DataFrame) -> DataFrame:
    """Adds picks (array<string>, of a box) and positions (array<array<string>>, of keys and straight bets)."""
    flat = F.from_json("selection", "array<string>")
    nested = F.from_json("selection", "array<array<string>>")
    return bets.withColumns({"picks": F.when(F.col("bet_type").isin(*BOXES), flat), "positions": F.when(~F.col("bet_type").isin(*BOXES), nested)})


def bet_cost(bets: DataFrame) -> DataFrame:
    """Adds bet_cost: the stake times the number of single bets."""
    b = parse_selection(bets)
    kind, n = F.col("bet_type"), F.size("picks").cast("long")
    need = F.when(kind.contains("Exacta"), 2).otherwise(3)
    times = (
        F.when((kind == "Exacta Box") & (n > 0), perm2(n))
        .when((kind == "Trifecta Box") & (n > 0), perm3(n))
        .when(kind.isin("WPS", "Win Place Show"), 3)
        .when(kind.isin("Win Place", "Place Show"), 2)
        .when(kind.contains("Key") & F.col("positions").isNotNull(), F.when(F.size("positions") >= need, key_combos(F.col("positions"))).otherwise(0))
        .otherwise(1)
    )
    return b.withColumn("bet_cost", (F.col("bet_amount") * times).cast(MONEY)).drop("picks", "positions")


def _spend(starts: np.ndarray, left: np.ndarray, cents: int) -> tuple[np.ndarray, np.ndarray]:
    """What is left of funds, as a function in pieces (funds from ``starts[i]`` on leave ``left[i]`` and what they exceed it by), after one more bet."""
    width = np.diff(starts, append=np.iinfo(np.int64).max)
    cut = (left < cents) & (cents - left < width)  # funds of one piece can pay from some point on
    at = np.flatnonzero(cut)
    more = starts[at] + cents - left[at]
    starts = np.insert(starts, at + 1, more)
    left = np.insert(left, at + 1, np.full(len(at), cents, np.int64))
    left = np.where(left >= cents, left - cents, left)
    shift = starts - left
    own = np.append(True, shift[1:] != shift[:-1])
    return starts[own], left[own]


def _in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[bool, tuple, int, int, list[list]]]:
    """(new, key, first row, end, columns) of runs of rows with equal first ``keys`` columns; ``new``: the key is not that of the run before."""
    before = None
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        at = 0
        for i in range(1, b.num_rows + 1):
            if i == b.num_rows or any(columns[k][i] != columns[k][at] for k in range(keys)):
                key = tuple(columns[k][at] for k in range(keys))
                yield key != before, key, at, i, columns
                before, at = key, i


def validate_bets(bets: DataFrame, races: DataFrame, funds: int = 1000) -> DataFrame:
    """Adds reject_reason (null: accepted): missing fields, no such race, or not enough funds left in the wallet.

    Only accepted bets are spent, in the order of created_at and bet_id: a bet that the wallet can't pay leaves
    the funds to later, cheaper ones.  bet_id is a key, and a bet without a wallet belongs to the wallet of those without.
    What an hour's bets leave of any funds is a function in pieces, made for each wallet and hour apart; a wallet's functions in
    order give the funds that each hour starts with, and each hour decides its bets from there.  So a wallet with many bets is many tasks.
    """
    known = races.select("race_id").distinct().withColumn("_race", F.lit(True))
    costed = bet_cost(bets)
    b = costed.join(known, "race_id", "left")
    reason = F.when(F.col("race_id").isNull() | F.col("bet_type").isNull(), "missing_fields").when(F.col("_race").isNull(), "race_not_found")
    hour = F.floor(F.unix_timestamp(F.col("created_at").cast("timestamp")) / 3600)
    asked = written(b.select("wallet_id", hour.alias("hour"), "bet_id", "created_at", F.coalesce((F.col("bet_cost") * 100).cast("long"), F.lit(0)).alias("cents"), reason.alias("reason")))
    most, kind = funds * 100, dict(bets.dtypes)
    order = ["wallet_id", "hour", "created_at", "bet_id"]

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, starts, left = None, None, None
        done: list[tuple] = []

        def out():
            columns = zip(zip(*done, strict=True), (wallet, pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["wallet_id", "hour", "starts", "left"])

        wallet = None
        for batch in batches:
            wallet = batch.schema.field(0).type
            for new, key, a, z, columns in _in_groups(iter([batch]), 2):
                if key != held:
                    if held is not None:
                        done.append((*held, starts[starts <= most], left[starts <= most]))
                    held, starts, left = key, NOTHING, NOTHING
                for cents in columns[2][a:z]:
                    if 0 < cents <= most:
                        # Of an hour's first bet: less than its cost stays, and more leaves the rest.
                        starts, left = (np.array([0, cents]), np.zeros(2, np.int64)) if starts is left is NOTHING else _spend(starts, left, cents)
                    elif cents < 0:
                        left = left - cents
                if len(done) >= GROUPS_OF_BATCH:
                    yield out()
                    done = []
        if held is not None:
            done.append((*held, starts[starts <= most], left[starts <= most]))
            yield out()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), 0
        for batch in batches:
            first = []
            for w, s, v in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if w != now:
                    now, left = w, most
                first.append(left)
                i = bisect_right(s, left) - 1
                left = v[i] + left - s[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(first, pa.int64())], ["wallet_id", "hour", "funds"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, 0
        for batch in batches:
            reasons = []
            for w, h, cents, why, first in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 4)), strict=True):
                if (w, h) != now:
                    now, left = (w, h), first
                if why is None and cents > left:
                    why = "insufficient_funds"
                elif why is None:
                    left -= cents
                reasons.append(why)
            yield pa.RecordBatch.from_arrays([batch.column(5), pa.array(reasons, pa.string())], ["bet_id", "reject_reason"])

    valid = asked.where("reason IS NULL").select(*order, "cents")
    made = valid.repartition("wallet_id", "hour").sortWithinPartitions(*order).select("wallet_id", "hour", "cents").mapInArrow(functions, f"wallet_id {kind['wallet_id']}, hour long, starts array<long>, left array<long>")
    starts = written(made.repartition("wallet_id").sortWithinPartitions("wallet_id", "hour").mapInArrow(begin, f"wallet_id {kind['wallet_id']}, hour long, funds long"))
    s = starts.select(F.col("wallet_id").alias("_wallet"), F.col("hour").alias("_hour"), "funds")
    with_funds = asked.join(s, asked.wallet_id.eqNullSafe(s["_wallet"]) & asked.hour.eqNullSafe(s["_hour"]), "left")
    dealt = with_funds.repartition("wallet_id", "hour").sortWithinPartitions(*order).select("wallet_id", "hour", "cents", "reason", F.coalesce("funds", F.lit(0)).alias("funds"), "bet_id")
    decided = dealt.mapInArrow(decide, f"bet_id {kind['bet_id']}, reject_reason string")
    return costed.select("race_id", *(c for c in costed.columns if c != "race_id")).join(decided, "bet_id")


def _runners(entries: DataFrame) -> DataFrame:
    """race_id, runners: a race's entries by place; a place of 0 is none."""
    place = F.when(F.col("finish_position") > 0, F.col("finish_position"))
    runner = F.struct(place.isNull().alias("unplaced"), place.alias("finish_position"), "program_number", "scratched", "win_payout", "place_payout", "show_payout")
    return entries.groupBy("race_id").agg(F.array_sort(F.collect_list(runner)).alias("runners"))


def _at(finishers: str, i: int) -> Column:
    return F.get(finishers, F.lit(i))


def settle(bets: DataFrame, races: DataFrame, entries: DataFrame, exotics: DataFrame, as_of: str) -> DataFrame:
    """bet_id, bet_type, old_status, new_status, payout: pending bets as they stand at ``as_of`` (a date).

    A scratched horse returns a bet on it before all else.  Completed races pay: places by the
    horse's payouts, combinations only if a leg earned, boxes and positions by the first
    fitting exotic payout, nothing without one.  Two days after their race, bets on a
    cancelled one are returned and others are lost.  A bet of no known type loses.
    """
    kind = F.lower("wager_type")
    first = lambda label: F.min_by("payout", F.when(kind.contains(label), F.col("seq")))
    paid_exotics = exotics.groupBy("race_id").agg(first("exacta").alias("exacta_payout"), first("trifecta").alias("trifecta_payout"))
    b = (
        parse_selection(bet_cost(bets.where("status = 'Pending'")))
        .join(races.select("race_id", "race_status", "race_date"), "race_id")
        .join(_runners(entries), "race_id", "left")
        .join(paid_exotics, "race_id", "left")
        .withColumn("_horse", F.get(F.filter("runners", lambda x: x["program_number"] == F.col("horse_number")), F.lit(0)))
        .withColumn("finishers", F.transform(F.filter("runners", lambda x: ~x["unplaced"]), lambda x: x["program_number"]))
        .select("*", *(F.col(f"_horse.{c}").alias(c) for c in ("scratched", "finish_position", "win_payout", "place_payout", "show_payout")))
        .drop("_horse", "runners")
    )
    kind, stake, pos = F.col("bet_type"), F.col("bet_amount"), F.col("finish_position")
    legs = {n: F.when(pos <= i, scale_payout(F.col(f"{n}_payout"), stake)).otherwise(F.lit(0).cast("decimal(20,5)")) for i, n in enumerate(("win", "place", "show"), 1)}
    zero = F.lit(0).cast(MONEY)
    earned = (
        F.when(kind == "Win", legs["win"]).when(kind == "Place", legs["place"]).when(kind == "Show", legs["show"])
        .when(kind == "Win Place", legs["win"] + legs["place"]).when(kind == "Place Show", legs["place"] + legs["show"])
        .when(kind.isin("WPS", "Win Place Show"), legs["win"] + legs["place"] + legs["show"]).otherwise(zero)
    )
    placed = F.when(kind == "Win", pos <= 1).when(kind == "Place", pos <= 2).when(kind == "Show", pos <= 3).otherwise(earned > 0)
    exacta = kind.contains("Exacta")
    need = F.when(exacta, 2).otherwise(3)
    n = F.size(F.coalesce("finishers", F.array().cast("array<string>")))
    boxed = (n >= need) & (F.size(F.array_except(F.slice("finishers", 1, need), "picks")) == 0)
    straight = (n >= need) & (F.size("positions") >= need)
    for i in range(3):
        straight = straight & ((F.lit(i) >= need) | F.array_contains(F.get("positions", F.lit(i)), _at("finishers", i)))
    hit = F.coalesce(F.when(kind.isin(*BOXES), boxed).when(kind.contains("Key") | kind.isin("Exacta", "Trifecta"), straight), F.lit(False))
    exotic = F.when(exacta, scale_payout(F.col("exacta_payout"), stake)).otherwise(scale_payout(F.col("trifecta_payout"), stake))
    single, done = kind.isin(*SINGLE), F.col("race_status") == "completed"
    stale = F.col("race_date") <= F.date_sub(F.lit(as_of).cast("date"), 2)
    won = F.coalesce(F.when(single, placed).otherwise(hit), F.lit(False))
    status = (
        F.when(single & F.coalesce("scratched", F.lit(False)), "Returned")
        .when(done & won, "Win")
        .when(done, "Loss")
        .when(stale & (F.col("race_status") == "cancelled"), "Returned")
        .when(stale, "Loss")
        .otherwise("Pending")
    )
    out = b.withColumn("new_status", status)
    paid = F.when(F.col("new_status") == "Returned", F.col("bet_cost")).when(F.col("new_status") == "Win", F.when(single, earned).otherwise(exotic)).otherwise(zero)
    return out.select("bet_id", "wallet_id", "bet_type", F.col("status").alias("old_status"), "new_status", F.coalesce(paid, zero).cast(MONEY).alias("payout"), "bet_cost", "created_at")


def ledger_entries(bets: DataFrame, settled: DataFrame, credit_scratch_refunds: bool = True) -> DataFrame:
    """wallet_id, reference_id, transaction_type, amount, at: a Bet for each, and Payouts and Refunds."""
    placed = bet_cost(bets).select("wallet_id", F.col("bet_id").alias("reference_id"), F.lit("Bet").alias("transaction_type"), (-F.col("bet_cost")).cast(MONEY).alias("amount"), F.col("created_at").alias("at"))
    kinds = ["Win", "Returned"] if credit_scratch_refunds else ["Win"]
    paid = settled.where(F.col("new_status").isin(*kinds) & (F.col("payout") > 0)).select(
        "wallet_id", F.col("bet_id").alias("reference_id"), F.when(F.col("new_status") == "Win", "Payout").otherwise("Refund").alias("transaction_type"), F.col("payout").cast(MONEY).alias("amount"), F.col("created_at").alias("at")
    )
    return placed.unionByName(paid)


def refund_deleted(bets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Refund rows for deleted bets that are still pending."""
    gone = bet_cost(bets.where("status = 'Pending'")).join(deleted.select("bet_id"), "bet_id", "left_semi")
    return gone.select("wallet_id", F.col("bet_id").alias("reference_id"), F.lit("Refund").alias("transaction_type"), F.col("bet_cost").alias("amount"), F.col("created_at").alias("at"))
