"""Sharding by histogram sort: rows in key order, cut into shards of nearly equal bytes.

The key is the hash of a row's group, the hash of its id, and a number that the
staged table keeps, so every row has its own place and rows of a group lie side
by side. A group is in two shards only where a cut falls into it, however large
it is.

Cuts are found by counting. Each round counts the exact bytes below a list of
probe keys in every partition and adds them up; for each cut that no probe meets
within the tolerance, the next round's probes divide the span from the least to
the largest key between its two nearest probes, which ends where that span is a
single row. Nothing is sampled. Shards are cut further into pieces of about
``piece_bytes``, so that one exchange deals out tasks of that size; the rows
counted below each piece give every row its slot.

The driver holds probe keys and their counts: 24 bytes and three numbers for
each of at most ``PROBES`` probes a piece, about a millionth of the input at 64 MB a piece.
A lost task reads the staged table again and gives the same cuts and slots.

Rows: any column may be null; a null group is one group; equal rows are apart by
their number; a row larger than a shard fills it alone, and a shard may be
empty; other columns pass through in ``row`` whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Bytes of a key: three 64-bit numbers, compared as unsigned bytes.
KEY = 24
#: Probes that a round puts between the two that are nearest to a cut.
PROBES = 32
#: Far more rounds than any key needs: each divides a span of keys by ``PROBES``.
MOST_ROUNDS = 60
COUNTED = "span int, bytes long, rows long, least binary, most binary"


def _number(key: bytes) -> int:
    return int.from_bytes(key, "big")


def _key(number: int) -> bytes:
    return number.to_bytes(KEY, "big")


def _counts(keyed: DataFrame, probes: list[bytes]) -> list[tuple[int, int, bytes | None, bytes | None]]:
    """Bytes, rows, least and largest key between neighbouring probes: one more than probes, summed in each task first."""
    shared = keyed.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, held = shared.value, {}
        for batch in batches:
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = held.get(span := bisect_right(cuts, key))
                if x is None:
                    held[span] = [size, 1, key, key]
                    continue
                x[0] += size
                x[1] += 1
                if key < x[2]:
                    x[2] = key
                elif key > x[3]:
                    x[3] = key
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        columns = zip(*[(span, *x) for span, x in held.items()], strict=True) if held else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)],
                                         names=[c.split()[0] for c in COUNTED.split(", ")])

    summed = keyed.mapInArrow(run, COUNTED).groupBy("span").agg(
        F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("most").alias("most"))
    out: list[tuple] = [(0, 0, None, None)] * (len(probes) + 1)
    for r in summed.collect():
        out[r.span] = (r.bytes, r.rows, bytes(r.least), bytes(r.most))
    shared.unpersist()
    return out


def splitters(keyed: DataFrame, total: int, shards: int, pieces: int, tolerance: float) -> list[bytes]:
    """Keys that cut ``keyed(key, size)`` into ``shards * pieces`` parts of nearly equal bytes.

    Cuts between shards miss their place by ``tolerance`` of a shard at most, those inside by a tenth of a piece, or
    by less than the row that lies across it.
    """
    parts = shards * pieces
    exact, loose = tolerance * total / shards, 0.1 * total / parts
    wanted = {k: (total * k / parts, exact if k % pieces == 0 else loose) for k in range(1, parts)}
    cuts: dict[int, bytes] = {}
    probes = sorted({_key((k << 8 * KEY) // (4 * parts)) for k in range(1, 4 * parts)})
    for _ in range(MOST_ROUNDS):
        if len(cuts) == len(wanted):
            return [cuts[k] for k in range(1, parts)]
        spans = [x for x in _counts(keyed, probes) if x[1]]
        ends, below = [], 0
        for x in spans:
            below += x[0]
            ends.append(below)
        between: dict[int, int] = {}
        for k, (target, miss) in wanted.items():
            if k in cuts:
                continue
            s = min(bisect_left(ends, target), len(spans) - 1)
            size, rows, least, most = spans[s]
            under, over = target - (ends[s] - size), ends[s] - target
            if min(under, over) <= miss or rows == 1:
                cuts[k] = least if under <= over else _key(_number(most) + 1)
            else:
                between[s] = between.get(s, 0) + 1
        dividing: set[int] = set()
        for s, n in between.items():  # the span's ends stay its ends, and its largest key gets a span of its own
            lo, hi, many = _number(spans[s][2]), _number(spans[s][3]), PROBES * n
            dividing.update((lo, lo + 1, hi, hi + 1), (lo + (hi - lo) * m // many for m in range(1, many)))
        probes = [_key(x) for x in sorted(dividing)]
    raise RuntimeError(f"cuts not found in {MOST_ROUNDS} rounds")


def shard_rows(df: DataFrame, shards: int, size: Column, group: Column | str, ident: Column | str,
               tolerance: float = 1e-3, piece_bytes: int = 64 << 20) -> DataFrame:
    """``row, size, shard, slot``: shards ``0..shards-1`` of nearly equal sums of ``size``, slots gapless from 0 in each.

    ``size`` is each row's whole number of bytes, not null; rows of a ``group`` lie side by side. Rows are read once
    to stage them, keys and sizes once a round, and whole rows are exchanged once.
    """
    def sixteen(x: Column) -> Column:
        return F.lpad(F.hex(x), 16, "0")

    group, ident = (F.col(c) if isinstance(c, str) else c for c in (group, ident))
    hashes = [F.xxhash64(group, group.isNull()), F.xxhash64(ident, ident.isNull()), F.monotonically_increasing_id()]
    staged = written(df.select(F.struct("*").alias("row"), size.cast("long").alias("size"),
                               F.unhex(F.concat(*map(sixteen, hashes))).alias("key")), "sharded")
    keyed = staged.select("key", "size")
    total = keyed.agg(F.sum("size")).first()[0] or 0
    pieces = max(1, -(-total // (shards * piece_bytes)))
    cuts = splitters(keyed, total, shards, pieces, tolerance) if total else []
    before = [0]
    for _, rows, _, _ in _counts(keyed, cuts) if cuts else []:
        before.append(before[-1] + rows)
    shared = staged.sparkSession.sparkContext.broadcast((cuts, before))

    def place(keys: pd.Series) -> pd.DataFrame:
        cuts, before = shared.value
        piece = [bisect_right(cuts, k) for k in keys]
        first = [before[p] - before[p // pieces * pieces] for p in piece]
        return pd.DataFrame({"piece": piece, "shard": [p // pieces for p in piece], "first": first})

    at = F.pandas_udf(place, "piece int, shard int, first long")
    placed = staged.withColumn("at", at("key"))
    # a piece is bounded, so one task numbers it; the rows of those before it in the shard are known
    order = F.row_number().over(Window.partitionBy("at.piece").orderBy("key"))
    return placed.withColumn("slot", F.col("at.first") + order - 1).select("row", "size", F.col("at.shard").alias("shard"), "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """A folder of Parquet files ``shard=N`` for each shard, the rows with their slots."""
    sharded.select("row.*", "slot", "shard").write.partitionBy("shard").parquet(path)
