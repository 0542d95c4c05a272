"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Far more rounds than the logarithm of any graph needs.
MOST_ROUNDS = 60


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (all larger ones, or all smaller ones and itself) are tied to its least neighbour."""
    if large:
        near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    tied = joined.where("v > u" if large else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` (any orderable type, not null); root is the least node.

    Each round is two joins and two grouped minima over the edges; the edges are
    checkpointed in the shared folder, so the plan does not grow and a lost
    executor repeats one round at most. A node of very high degree is only ever
    the key of a grouped minimum (summed before the shuffle) and of a join that
    Spark splits. Ends when a round changes nothing.
    """
    checkpoint_dir(edges.sparkSession)
    pairs = edges.select("u", "v").where("u <> v").distinct().checkpoint()
    before = None
    for _ in range(MOST_ROUNDS):
        pairs = _star(_star(pairs, True), False).checkpoint()
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
