"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has 64 bits; bit b is set if over half of its shingles'
hashes have it. Fingerprints that differ in at most ``bits`` bits are linked. A
fingerprint is cut into so few segments that two linked ones differ by at most
one bit in some segment: for three bits, two segments of 32. Each segment is
indexed once for each of its positions with that bit taken out; an equality
join on these variants finds every linked pair, and counting the bits that
differ verifies it.

Equal fingerprints are one node, so a group of copies costs one row after the
first grouping, which sums before its shuffle. The join's condition holds the
verification, so that only links leave it, each once.

Rows: a null text counts as empty; a text without words has fingerprint zero
and is linked like any other; a null document id gets a fingerprint but is no
candidate for the least id of its group (a group of null ids alone has a null
component); repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .components import components

SEED = 42
LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
SPACES = b" \t\n\x0b\x0c\r"
#: Set bits of a byte, least first.
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
#: Shingles that are counted at once.
BLOCK = 1 << 18


def fingerprint(text: str | None, words: int = 3) -> int:
    """Fingerprint of one text as a signed 64-bit integer."""
    import xxhash

    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    digest, total, count = xxhash.xxh64_digest, 0, np.zeros((8, 256), dtype=np.int64)
    if len(parts) < words:
        parts = [b" ".join(parts)]
        words = 1
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    first, last = (ends - lengths)[: len(parts) - words + 1], ends[words - 1:]
    for at in range(0, len(first), BLOCK):
        a, b = first[at: at + BLOCK].tolist(), last[at: at + BLOCK].tolist()
        raw = b"".join([digest(joined[i:j], SEED) for i, j in zip(a, b, strict=True)])
        byte = np.frombuffer(raw, np.uint8).reshape(-1, 8) + np.arange(8, dtype=np.int64) * 256
        count += np.bincount(byte.ravel(), minlength=2048).reshape(8, 256)
        total += len(a)
    ones = count @ BITS  # digests are big-endian: row 0 is the top byte
    value = np.packbits((2 * ones > total)[:, ::-1], axis=1).tobytes()
    return int.from_bytes(value, "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, _k1, _k2, fp`` of whole texts, one row per input row; the keys are those of id and text."""
    schema = pa.schema([("doc_id", pa.int64()), ("_k1", pa.int64()), ("_k2", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = pa.array([fingerprint(t, words) for t in part.column(3).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], fps], schema=schema)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    return docs.mapInArrow(run, "doc_id long, _k1 long, _k2 long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """``u, v`` with u < v: the distinct values of ``fp`` at most ``bits`` bits apart."""
    segments = bits // 2 + 1
    width = -(-64 // segments)
    distinct = fps.select("fp").distinct()
    spots = [(s, p) for s in range(segments) for p in range(min(width, 64 - s * width))]

    def variant(segment: int, spot: int):
        mask = ((1 << min(width, 64 - segment * width)) - 1) & ~(1 << spot)
        part = F.shiftrightunsigned("fp", segment * width).bitwiseAND(F.lit(_signed(mask)))
        return F.struct(F.lit(segment * 64 + spot).cast("short").alias("place"), part.alias("part"))

    index = distinct.select("fp", F.explode(F.array(*[variant(s, p) for s, p in spots])).alias("x"))
    index = index.select("fp", "x.place", "x.part")
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    size = F.lit(_signed((1 << width) - 1))

    def at(segment: int):
        return F.shiftrightunsigned(differ, segment * width).bitwiseAND(size)

    # A pair meets at many places; it is taken at the first one: the lowest segment with at most
    # one differing bit, at that bit, or at bit 0 if the segments are equal.
    place = F.lit(-1)
    for s in reversed(range(segments)):
        lone = F.when(at(s) == 0, F.lit(s * 64)).otherwise(s * 64 + F.bit_count(at(s) - 1))
        place = F.when(F.bit_count(at(s)) <= 1, lone).otherwise(place)
    pairs = a.join(b, (F.col("a.place") == F.col("b.place")) & (F.col("a.part") == F.col("b.part"))
                   & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= bits) & (F.col("a.place") == place))
    return pairs.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    bits: int = 3) -> DataFrame:
    """``doc_id, fp, component_id, _k1, _k2``: one row per input row; the least id reachable by links, itself included."""
    fps = written(fingerprints(df, id_col, text_col, words), "simhash")
    roots = components(links(fps, bits))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    group = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(joined.join(group, "root").select("fp", "root", "component_id"), "simhash-nodes")
    return fps.join(named, "fp").select("doc_id", "fp", "root", "component_id", "_k1", "_k2")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """The rows of ``df`` that stay when each group keeps one: that of the least id (a null id counts as the largest,
    a tie goes to the least key), and of rows equal in id and text one."""
    found = written(near_duplicates(df, id_col, text_col, words, bits), "simhash-groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_k1", "_k2")
    first = found.groupBy("root").agg(F.min(order).alias("first"))
    marked = found.select("root", "_k1", "_k2", order.alias("at")).join(first, "root")
    gone = marked.where("at <> first").select("_k1", "_k2").distinct()
    again = marked.where("at = first").groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k1", "_k2")
    gone, again = written(gone, "simhash-gone"), written(again, "simhash-again")
    rows = df.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    stay = rows.join(gone.unionByName(again), ["_k1", "_k2"], "left_anti").select("row")
    if not again.isEmpty():
        once = rows.join(again, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"]).select("row")
        stay = stay.unionByName(once)
    return stay.select(*[F.col("row")[c].alias(c) for c in df.columns])
