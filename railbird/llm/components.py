"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.llm.stage import shared_dir


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round.  Large: a node's larger neighbours move to its least one.
    Small: a node and its smaller neighbours move to the least of them."""
    if large:
        near = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Written apart, so that the join below meets two plain shuffles and can split a node with many neighbours.
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
    joined = near.join(least, "u")
    if large:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v) of any comparable type -> (node, root), root the least node.

    Nodes without an edge don't appear.  Self-loops, repeated and reversed edges
    are allowed; edges with a null end are ignored.  Rounds and minima are
    checkpointed, and minima are aggregated before any join, so that a node with
    many neighbours gathers nowhere.
    """
    shared_dir(edges.sparkSession)
    now = (
        edges.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
        .checkpoint()
    )
    before = None
    for _ in range(max_rounds):
        now = _stars(_stars(now, True), False).checkpoint()
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
