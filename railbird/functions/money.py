"""Percentages, payouts and numbers of combinations.  Money is decimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def win_pct(wins: Column, starts: Column) -> Column:
    """One place, ties to even; 0 without starts."""
    return F.when(starts > 0, F.bround(wins * 100.0 / starts, 1)).otherwise(F.lit(0.0))


def perm2(n: Column) -> Column:
    return n * (n - 1)


def perm3(n: Column) -> Column:
    return n * (n - 1) * (n - 2)


def scale_payout(base: Column, stake: Column) -> Column:
    """Payouts are quoted for two; null is nothing.  Not rounded: legs are added first."""
    return (F.coalesce(base, F.lit(0)).cast("decimal(10,2)") * stake.cast("decimal(8,2)") / 2).cast("decimal(20,5)")


def key_combos(positions: Column) -> Column:
    """Ways to choose one of each list of an array of two or three lists, no choice twice (inclusion and exclusion)."""
    a, b, c = (F.coalesce(F.get(positions, F.lit(i)), F.array().cast("array<string>")) for i in range(3))
    n = lambda x: F.size(x).cast("long")
    both = lambda x, y: F.size(F.filter(x, lambda v: F.array_contains(y, v))).cast("long")
    pair = n(a) * n(b) - both(a, b)
    all3 = F.size(F.filter(a, lambda v: F.array_contains(b, v) & F.array_contains(c, v))).cast("long")
    three = n(a) * n(b) * n(c) - both(a, b) * n(c) - both(a, c) * n(b) - both(b, c) * n(a) + 2 * all3
    return F.when(F.size(positions) == 2, pair).when(F.size(positions) == 3, three).otherwise(F.lit(0).cast("long"))
