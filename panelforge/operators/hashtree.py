"""The difference of two table states by trees of digests over key ranges.

A state's tree has a leaf for each range of its range key (a day, a block of
ids), with the number of rows in it and the sum of their hashes, and above them
levels of :data:`FANOUT` nodes each, up to one root. A leaf is a partial
aggregate: no row is shuffled to build a tree, and trees can be kept beside the
states they describe.

Two trees are compared from the root down, each level only below the nodes that
differ. Rows are read again only from the ranges whose leaves differ: runs of
neighbouring leaves become range conditions on the key, which reach the scan where
it is a stored column, so that equal row groups are not even read. Only these rows are shuffled, summed by
value first, and those whose numbers differ are the difference, repeats included.

Digests are sums of 64-bit hashes of typed values, exact in decimals: equal
ranges always agree; ranges that differ agree by chance with odds of about 2^-64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rowcode import whole_sum
from ..session import checkpoint_dir

#: Nodes below one node.
FANOUT = 16
#: Range conditions in one filter; more differing ranges are found by a join on the leaf instead.
MOST_RANGES = 200


def leaves(df: DataFrame, range_key: str, width: int, cols) -> DataFrame:
    """``level 0``: ``node, n, digest`` of each range of ``width`` values of the whole-number ``range_key``.

    Rows without a key make the leaf ``node = null``.
    """
    marked = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    node = F.floor(F.col(range_key) / F.lit(width)).cast("bigint")
    return df.groupBy(node.alias("node")).agg(F.count(F.lit(1)).alias("n"), whole_sum(F.xxhash64(*marked)).alias("digest"))


def build_tree(df: DataFrame, range_key: str, width: int, cols, levels: int) -> DataFrame:
    """``level, node, n, digest``: the leaves (level 0) and ``levels`` levels above them, from one pass over ``df``.

    Every level is summed from the leaves, which are as many as ranges that have rows.
    """
    leaf = leaves(df, range_key, width, cols)
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    up = leaf.select(at, "node", "n", "digest").withColumn("node", F.floor(F.col("node") / F.pow(F.lit(float(FANOUT)), "level")).cast("bigint"))
    return up.groupBy("level", "node").agg(F.sum("n").cast("bigint").alias("n"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def differing(a: DataFrame, b: DataFrame, levels: int) -> DataFrame:
    """``node`` of the leaves that differ in two trees, found from the top level down; ``null`` is a leaf like any other.

    Each step looks only at the children of the nodes that differ. Nothing of it goes through the driver.
    """
    def level(tree: DataFrame, k: int, side: str, below: DataFrame | None) -> DataFrame:
        nodes = tree.where(F.col("level") == k).select("node", F.col("n").alias(f"n_{side}"), F.col("digest").alias(f"d_{side}"))
        if below is None:
            return nodes
        above = below.select(F.col("node").alias("__above"))
        return nodes.join(above, F.floor(F.col("node") / FANOUT).cast("bigint").eqNullSafe(F.col("__above")), "left_semi")

    found = None
    for k in range(levels, -1, -1):
        x, y = level(a, k, "a", found), level(b, k, "b", found)
        both = x.withColumnRenamed("node", "__a").join(y.withColumnRenamed("node", "__b"), F.expr("__a <=> __b"), "full")
        same = F.col("n_a").eqNullSafe(F.col("n_b")) & F.col("d_a").eqNullSafe(F.col("d_b"))
        found = both.where(~same).select(F.coalesce("__a", "__b").alias("node"))
    return found


def runs_of(nodes: list[int]) -> list[tuple[int, int]]:
    """Sorted whole numbers as runs ``(first, last)`` of neighbours."""
    out: list[list[int]] = []
    for x in sorted(nodes):
        if out and x == out[-1][1] + 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def _among(x: Column, nodes: list[int], scale: int = 1) -> Column:
    """Whether ``x`` lies in one of the runs of ``nodes``, each ``scale`` values wide."""
    out = F.lit(False)
    for a, b in runs_of(nodes):
        out = out | ((x >= a * scale) & (x < (b + 1) * scale))
    return out


def rows_in(df: DataFrame, range_key: str, width: int, found: DataFrame, count: int) -> DataFrame:
    """The rows of ``df`` in the ``count`` leaves of ``found``: by range conditions where these are few, else by a join."""
    none = F.col(range_key).isNull()
    if count <= 64 * MOST_RANGES:       # a bounded list of whole numbers
        nodes = [r[0] for r in found.collect()]
        known = [v for v in nodes if v is not None]
        runs = runs_of(known)
        if len(runs) <= MOST_RANGES:
            inside = _among(F.col(range_key), known, width)
            return df.where(inside | none if None in nodes else inside)
    keyed = df.withColumn("__node", F.floor(F.col(range_key) / F.lit(width)).cast("bigint"))
    return keyed.join(found.select(F.col("node").alias("__found")), F.col("__node").eqNullSafe(F.col("__found")), "left_semi").drop("__node")


def state_diff(a: DataFrame, b: DataFrame, range_key: str, width: int, cols, levels: int = 3,
               trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows that two states hold in different numbers: ``cols, n_a, n_b``; repeats and nulls count.

    ``trees`` are kept trees of both states (see :func:`build_tree`, same key, width, columns and levels); without
    them both are built first.
    """
    cols = list(cols)
    checkpoint_dir(a.sparkSession)
    ta, tb = trees or [build_tree(df, range_key, width, cols, levels).checkpoint() for df in (a, b)]
    found = differing(ta, tb, levels).checkpoint()
    count = found.count()
    key = [range_key] if range_key not in cols else []
    sides = [rows_in(df.select(*cols, *key), range_key, width, found, count).select(
        *cols, F.lit(n).cast("bigint").alias("__a"), F.lit(1 - n).cast("bigint").alias("__b")) for df, n in ((a, 1), (b, 0))]
    summed = sides[0].unionByName(sides[1]).groupBy(*cols).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"))
    return summed.where("n_a <> n_b")
