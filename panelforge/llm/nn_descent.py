"""Embedding near-dedup by NN-descent.

Equal vectors are one node with a weight. A neighbour graph of ``k`` entries a
node starts from sorted hyperplane codes (each of ``tables`` random tables sorts
the nodes by a sign code; nodes in a window of the order are compared) and is
refined by local joins: all who have or are a neighbour of a node meet at that
node, are compared there, and pairs better than a member's list enter it. A list
is saturated if all its entries are links (cosine >= ``threshold``): it may hold
too few. Such lists are enlarged without limit: saturated nodes of different
components are compared in the tables' windows again, which joins components that
links cut from full lists connect; then the nodes of a saturated node's component
are compared in blocks, and each node's links are counted there; pairs are never
listed. An audit compares a bounded random set of nodes with all
others; while the recall of links, averaged over nodes, is below ``recall``, more
tables are added, and if they don't help, the query fails.

What meets in one task is bounded: windows and blocks have fixed sizes, a node
with many reverse neighbours is split into chunks by a hash that changes each
round, copies count as weights. A component of m nodes whose lists are saturated
costs m * m / block block comparisons, as its links may be that many.

Rows: vectors that are null, empty or zero or hold null or non-finite components
link with nothing; vectors of different lengths don't link; a null id stays null
and is no candidate for the least id (a row without other ids in its group has a
null component and is kept); rows that repeat are different vectors at cosine 1;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import row_key, written
from .components import components

LOG = logging.getLogger(__name__)
CODE_BITS = 24
#: Nodes compared at once in a table's order; half of a window overlaps the next.
SPAN = 64
#: Members of a chunk of a local join, about.
CHUNK = 64
#: Best partners of a node that a window or a local join hands on.
HANDED = 4
#: Nodes of a component that stand for it among other components in a table's order, about.
FEW = 8
#: Nodes of a block where saturated lists are enlarged.
BLOCK = 512
EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64())])
EDGE_SQL = "u long, v long, sim double"


def _matrix(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision, a row each."""
    out = []
    for v in column.to_numpy(zero_copy_only=False):
        x = np.asarray(v, dtype=np.float64)
        x = x / np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


def valid(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _best(sims: np.ndarray, ids: np.ndarray, k: int, threshold: float, floor: np.ndarray | float = -2.0,
          roots: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of ``sims`` the best HANDED other columns above ``floor`` (k of them, as a list holds, if they
    are links), as edges; with ``roots`` only columns of another root."""
    n = len(ids)
    sims = sims.copy()
    np.fill_diagonal(sims, -9.0)
    if roots is not None:
        sims[roots[:, None] == roots[None, :]] = -9.0
    m = min(max(k, HANDED), n - 1)
    if m < 1:
        return ids[:0], ids[:0], np.zeros(0)
    cols = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    value = np.take_along_axis(sims, cols, axis=1)
    order = np.argsort(-value, axis=1)
    cols, value = np.take_along_axis(cols, order, axis=1), np.take_along_axis(value, order, axis=1)
    low = floor[:, None] if isinstance(floor, np.ndarray) else floor
    good = (value > low) & ((np.arange(m) < HANDED) | (value >= threshold))
    rows, at = np.nonzero(good)
    return ids[rows], ids[cols[rows, at]], value[rows, at]


def _edges(parts: list[tuple]) -> pa.RecordBatch:
    cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=EDGE)


def _first_edges(nodes: DataFrame, tables: range, seed: int, k: int, threshold: float) -> DataFrame:
    """Edges from the windows of each table's order; if ``nodes`` have roots, links between different roots only,
    also from windows of at most about FEW nodes of each root.
    """
    apart = "root" in nodes.columns
    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _matrix(batch.column(1))
            for t in tables:
                code = []
                for x in unit:
                    if (t, len(x)) not in planes:
                        planes[t, len(x)] = np.random.default_rng([seed, t, len(x)]).standard_normal((len(x), CODE_BITS))
                    code.append(x @ planes[t, len(x)] > 0)
                value = np.array(code) @ (1 << np.arange(CODE_BITS)[::-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(unit), t, np.int32)), pa.array([len(x) for x in unit], pa.int32()),
                     pa.array(value.astype(np.int64)), batch.column(0), batch.column(1), batch.column(2)],
                    names=["t", "dim", "code", "node", "vec", "root"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare(group: list[tuple]) -> tuple:
            ids = np.array([g[2] for g in group])
            x = np.stack([g[3] for g in group])
            if apart:
                return _best(x @ x.T, ids, HANDED, threshold, np.nextafter(threshold, -2.0), np.array([g[4] for g in group]))
            return _best(x @ x.T, ids, k, threshold)

        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(),
                            _matrix(batch.column(4)), batch.column(5).to_pylist(), strict=True))
            out = []
            for row in rows:
                if held and row[:2] != held[-1][:2]:
                    out.append(compare(held))
                    held = []
                held.append(row)
                if len(held) == SPAN:
                    out.append(compare(held))
                    held = held[SPAN // 2:]
            if out:
                yield _edges(out)
        if held:
            yield _edges([compare(held)])

    kind = nodes.schema["vec"].dataType.simpleString()
    root = F.col("root" if apart else "node").alias("root")
    coded = nodes.select("node", "vec", root).mapInArrow(codes, f"t int, dim int, code long, node long, vec {kind}, root long")
    if apart:
        sizes = nodes.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > FEW)
        some = coded.join(sizes, "root", "left").where(
            F.col("size").isNull() | (F.pmod(F.xxhash64(F.lit("few"), "t", "node"), "size") < FEW))
        coded = coded.unionByName(some.select((-1 - F.col("t")).alias("t"), "dim", "code", "node", "vec", "root"))
    order = ["t", "dim", "code", "node"]
    return coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(windows, EDGE_SQL)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best entries of each list; pairs found twice count once, also if their products differ in the last bit."""
    once = edges.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return once.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _round(graph: DataFrame, nodes: DataFrame, k: int, turn: int, threshold: float) -> DataFrame:
    """One local join: edges that are better than the worst entry of a list."""
    worst = graph.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("low"))
    floor = F.when(F.col("n") >= k, F.col("low")).otherwise(-2.0)
    members = graph.select(F.col("u").alias("c"), F.col("v").alias("m")).unionByName(
        graph.select(F.col("v").alias("c"), F.col("u").alias("m"))).unionByName(
        graph.select(F.col("u").alias("c"), F.col("u").alias("m"))).distinct()
    degrees = members.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks"))
    chunk = F.pmod(F.xxhash64(F.lit(turn), "m"), "chunks").alias("chunk")
    members = members.join(degrees, "c").select("c", "m", chunk)
    known = nodes.select("node", "vec").join(worst.select(F.col("u").alias("node"), floor.alias("floor")), "node", "left")
    met = members.join(known, F.col("m") == F.col("node")).select("c", "chunk", "m", "vec", F.coalesce("floor", F.lit(-2.0)).alias("floor"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare() -> tuple:
            ids, x = np.array([h[2] for h in held]), np.stack([h[4] for h in held])
            return _best(x @ x.T, ids, k, threshold, np.array([h[3] for h in held]))

        for batch in batches:
            out = []
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                           batch.column(4).to_pylist(), _matrix(batch.column(3)), strict=True):
                if held and row[:2] != held[-1][:2]:
                    out.append(compare())
                    held = []
                held.append(row)
            if out:
                yield _edges(out)
        if held:
            yield _edges([compare()])

    return met.repartition("c", "chunk").sortWithinPartitions("c", "chunk", "m").mapInArrow(join, EDGE_SQL)


def _dense_counts(dense: DataFrame, threshold: float) -> DataFrame:
    """``node, links, pairs``: weights and number of all linked others in the same component, from ``root, node, n, vec``."""
    sizes = dense.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    spread = dense.join(sizes, "root").withColumn("b", mine)
    spread = spread.select("root", "node", "n", "vec", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    spread = spread.select("root", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "node", "n", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def compare() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j = held[0][1], held[0][2]
            side = np.array([h[3] for h in held])
            ids, weight, x = np.array([h[4] for h in held]), np.array([h[5] for h in held], np.int64), np.stack([h[6] for h in held])
            total, pairs = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            if i == j:
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                total, pairs = near @ weight, near.sum(axis=1)
            else:
                a, b = np.flatnonzero(side == i), np.flatnonzero(side == j)
                near = x[a] @ x[b].T >= threshold
                total[a], total[b] = near @ weight[b], near.T @ weight[a]
                pairs[a], pairs[b] = near.sum(axis=1), near.sum(axis=0)
            return ids, total, pairs

        def batch_of(parts: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names=["node", "links", "pairs"])

        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(6)), _matrix(batch.column(6)), strict=True):
                if held and row[:3] != held[-1][:3]:
                    out.append(compare())
                    held = []
                held.append(row)
            if out:
                yield batch_of(out)
        if held:
            yield batch_of([compare()])

    parts = spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "b", "node").mapInArrow(
        count, "node long, links long, pairs long")
    return parts.groupBy("node").agg(F.sum("links").alias("links"), F.sum("pairs").alias("pairs"))


def _counted(strong: DataFrame, full: DataFrame, roots: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, root, links, pairs`` for each node that has a link: weight and number of its linked nodes."""
    both = strong.select("u", "v").unionByName(strong.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    dense = roots.join(full, "node").select("root").distinct().withColumn("dense", F.lit(True))
    marked = roots.join(dense, "root", "left").join(nodes, "node")
    heavy = marked.where("dense").select("root", "node", "n", "vec")
    plain = both.join(nodes.select(F.col("node").alias("v"), "n"), "v").groupBy(F.col("u").alias("node")).agg(
        F.sum("n").alias("links"), F.count(F.lit(1)).alias("pairs"))
    plain = marked.where("dense is null").select("node").join(plain, "node")
    links = plain.unionByName(_dense_counts(heavy, threshold))
    return roots.join(links, "node", "left").select(
        "node", "root", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def _linked(graph: DataFrame, nodes: DataFrame, k: int, threshold: float, tables: range, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``u, v`` of all links in lists and of bridges, ``node`` of saturated lists, and ``node, root``.

    A link can only be cut from the lists if both its nodes are saturated. So saturated nodes of different
    components are compared again, and links found join the components, until there are none.
    """
    strong = written(graph.where(F.col("sim") >= threshold).select("u", "v"), "strong-edges")
    full = written(strong.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("u").alias("node")), "saturated")
    while True:
        roots = written(components(strong), "vector-components")
        ends = full.join(roots, "node").join(nodes.select("node", "vec"), "node")
        if ends.select("root").distinct().limit(2).count() < 2:
            return strong, full, roots
        bridges = written(_first_edges(ends, tables, seed, k, threshold).select("u", "v").distinct(), "bridges")
        if bridges.isEmpty():
            return strong, full, roots
        strong = strong.unionByName(bridges)


def audit(nodes: DataFrame, counted: DataFrame, threshold: float, size: int, k: int) -> float:
    """Share of linked nodes found, averaged over ``size`` nodes taken by hash, which are compared with all others.

    Copies don't count, and each asked node counts alike; nodes with at most ``k`` links and those with more are
    averaged apart, and the lower average is returned.
    """
    asked = nodes.orderBy(F.xxhash64(F.lit("audit"), "node")).limit(size).join(counted, "node", "left").select(
        "node", "vec", F.coalesce("pairs", F.lit(0)).alias("pairs")).collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r.vec) for r in asked}:
        rows = [r for r in asked if len(r.vec) == dim]
        by_dim[dim] = np.array([r.node for r in rows]), np.stack(_matrix(pa.array([r.vec for r in rows], pa.list_(pa.float64()))))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for dim, (asked_ids, x) in by_dim.items():
                at = [i for i, y in enumerate(unit) if len(y) == dim]
                if at:
                    near = (x @ np.stack([unit[i] for i in at]).T >= threshold) & (asked_ids[:, None] != ids[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(asked_ids), pa.array(near.sum(axis=1))], names=["node", "pairs"])

    true = {r.node: r.pairs for r in nodes.select("node", "vec").mapInArrow(compare, "node long, pairs long").groupBy("node").agg(
        F.sum("pairs").alias("pairs")).collect()}
    shares: dict[bool, list[float]] = {}
    for r in asked:
        want = true.get(r.node, 0)
        if want:
            shares.setdefault(want > k, []).append(min(r.pairs, want) / want)
    return min((sum(x) / len(x) for x in shares.values()), default=1.0)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, k: int = 10,
                 tables: int = 16, rounds: int = 2, recall: float = 0.98, audited: int = 1024, attempts: int = 4,
                 seed: int = 11) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per input row.

    ``rounds`` local joins follow each batch of ``tables`` tables; batches are added until the audit of ``audited``
    nodes finds ``recall`` of their links. ``attempts`` batches in a row that raise it no further are an error.
    """
    base = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    good = base.where(valid(F.col("vec"))).select("*", *row_key("vec"))
    nodes = good.groupBy("_k1", "_k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    graph, best, idle = None, -1.0, 0
    for attempt in itertools.count():
        batch = range(attempt * tables, (attempt + 1) * tables)
        edges = _first_edges(nodes, batch, seed, k, threshold)
        graph = written(_top(edges if graph is None else edges.unionByName(graph), k), "neighbours")
        for turn in range(rounds):
            graph = written(_top(_round(graph, nodes, k, attempt * rounds + turn, threshold).unionByName(graph), k), "neighbours")
        counted = written(_counted(*_linked(graph, nodes, k, threshold, batch, seed), nodes, threshold), "links")
        found = audit(nodes.select("node", "vec"), counted, threshold, audited, k)
        LOG.info("tables %d: recall %.4f", (attempt + 1) * tables, found)
        if found >= recall:
            break
        best, idle = max(best, found), idle + 1 if found <= best else 0
        if idle >= attempts:
            raise RuntimeError(f"recall of links stays at {best:.4f} after {(attempt + 1) * tables} tables, {recall} is asked")
    groups = nodes.join(counted, "node", "left").select(
        "_k1", "_k2", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    named = groups.join(least, "root").select("_k1", "_k2", "n_links", "component_id")
    rows = base.select("vec_id", valid(F.col("vec")).alias("good"), *row_key("vec"))
    out = rows.where("good").join(named, ["_k1", "_k2"]).select("vec_id", "n_links", "component_id").unionByName(
        rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
