"""Cross-tokenizer alignment over distinct texts: which ids of one vocabulary stand for which of another.

Equal texts are brought together by a shuffle on the full text, and each
distinct one is tokenized and aligned once. Both token sequences cover the same
bytes; offsets at which a token of either ends cut them into groups, and within
a group every token of A is linked to every token of B. An id pair counts once
for each document that links it, so a distinct text adds its multiplicity. The
measures that rest on these corpus-wide counts are joined to the rows last, by
the text's SHA-256.

Tasks gather distinct texts into blocks of about :data:`BLOCK_LINKS` different
links. A block's different pairs are what meets the corpus-wide counts, not the
links of each text, and the block with its counts is one bounded group. A pair
that every text holds is one row a block; a text that a third of all rows repeat
is one row before its shuffle and only ever the key of a join that Spark splits.

Texts are aligned many at a time on arrays: token ends are running sums of byte
lengths, groups come from the ends that both sides have, links from repeating
each token of A over its group's tokens of B.

Rows: a null or empty text, and one whose joined bytes differ from a space and
the text, has no tokens, zeros and an empty alignment; a null document id stays
null; repeated rows repeat and each counts as a document; other columns pass
through in ``row`` whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Different links that a block of texts gathers before the next one begins; its last text may exceed it.
BLOCK_LINKS = 1 << 20
#: Links of a group from which they are counted by id pair instead of listed.
LISTED = 1 << 12
#: A word or run of white space this long is left to the library whose time is not quadratic in a word's length.
LONG_RUN = 1000
LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)
#: The splitting rule of byte-level vocabularies (fixed value, must equal the vocabulary's).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STAGED = ("block long, digest string, n_a long, n_b long, n_groups long, n_links long, alignment string, "
          "pairs array<int>, times array<long>")
MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Tokens, groups and links of texts under two vocabulary files: byte-level BPE, and pieces with byte fallback."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        chars = _byte_chars()
        self.a_size, self.b_size = self.a.get_vocab_size(), self.b.get_piece_size()
        if self.a_size * self.b_size > 1 << 31:
            raise ValueError("an id pair must fit in 31 bits")
        self.a_bytes = [b""] * self.a_size
        for piece, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(chars[c] for c in piece) if all(c in chars for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b_size)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # an id of A before a comma and before a bar, an id of B before a comma and before a semicolon
        self.marked = [f"{i}{end}" for size, ends in ((self.a_size, ",|"), (self.b_size, ",;")) for end in ends for i in range(size)]
        self.ranked = self._by_ranks(a_path)

    def _by_ranks(self, path: str):
        """The same vocabulary for the faster library, if its ids are in the order of its merges; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made.get("pre_tokenizer") or {}
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if made.get("normalizer") or not plain or merged != list(range(256, 256 + len(merged))):
            return None
        special = {x["id"] for x in made["added_tokens"]}
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in special}
        return tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def _a_ids(self, text: str) -> list[int]:
        if self.ranked is None or max(map(len, text.split()), default=0) >= LONG_RUN or LONG_BLANK.search(text):
            return self.a.encode(text, add_special_tokens=False).ids
        return self.ranked.encode_ordinary(text)

    def align(self, texts: list[str], hashed: bool = False) -> list[tuple]:
        """``(n_a, n_b, n_groups, n_links, alignment, pairs, times)`` of each text; the last two are arrays of its
        different id pairs (``a * b_size + b``) and of their links."""
        out: list[tuple] = [(0, 0, 0, 0, "", np.zeros(0, np.int32), np.zeros(0, np.int64))] * len(texts)
        kept, left, right = [], [], []
        for k, (text, b) in enumerate(zip(texts, self.b.encode(texts, num_threads=1), strict=True)):
            if not text:
                continue
            raw, a = (" " + text).encode(), self._a_ids(" " + text)
            if b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw:
                kept.append(k)
                left.append(a)
                right.append(b)
        for k, row in zip(kept, self._grouped(left, right, hashed) if kept else [], strict=True):
            out[k] = row
        return out

    def _grouped(self, left: list[list[int]], right: list[list[int]], hashed: bool) -> Iterator[tuple]:
        """Rows of :meth:`align` for texts laid end to end; every text has a token on both sides."""
        a_many, b_many = (np.array([len(x) for x in side]) for side in (left, right))
        a, b = (np.concatenate([np.array(x, np.int64) for x in side]) for side in (left, right))
        a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.intersect1d(a_end, b_end, assume_unique=True)
        a_group, b_group = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
        n_a, n_b = np.bincount(a_group, minlength=len(ends)), np.bincount(b_group, minlength=len(ends))
        a_last, b_last = np.cumsum(n_a) - 1, np.cumsum(n_b) - 1
        text_of = np.repeat(np.arange(len(left)), a_many)
        first_group = a_group[np.cumsum(a_many) - a_many]
        n_groups = np.diff(np.append(first_group, len(ends)))
        n_links = np.add.reduceat(n_a * n_b, first_group)

        # links: each token of A with every token of B of its group
        few = (n_a * n_b <= LISTED)[a_group]
        times = np.where(few, n_b[a_group], 0)
        mate = np.repeat(b_last[a_group] + 1 - n_b[a_group], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        key = np.repeat(text_of << 31 | a * self.b_size, times) + b[mate]
        key, count = np.unique(key, return_counts=True)
        if not few.all():
            more: Counter = Counter()
            for g in np.flatnonzero(n_a * n_b > LISTED).tolist():
                lo, others = a_last[g] + 1 - n_a[g], Counter(b[b_last[g] + 1 - n_b[g]: b_last[g] + 1].tolist())
                at = int(text_of[lo]) << 31
                for x, n in Counter(a[lo: a_last[g] + 1].tolist()).items():
                    for y, m in others.items():
                        more[at | (x * self.b_size + y)] += n * m
            key = np.concatenate([key, np.fromiter(more.keys(), np.int64, len(more))])
            count = np.concatenate([count, np.fromiter(more.values(), np.int64, len(more))])
            key, place = np.unique(key, return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, count)
            count = total
        cut = np.searchsorted(key >> 31, np.arange(len(left) + 1))
        pairs = (key & ((1 << 31) - 1)).astype(np.int32)

        # text of the groups: ids in the order group, side, position, each with the mark behind it
        marks = np.empty(len(a) + len(b), np.int64)
        is_last = np.zeros(len(a), np.int64)
        is_last[a_last] = self.a_size
        marks[np.arange(len(a)) + (b_last - n_b + 1)[a_group]] = a + is_last
        is_last = np.zeros(len(b), np.int64)
        is_last[b_last] = self.b_size
        marks[np.arange(len(b)) + (a_last + 1)[b_group]] = b + is_last + 2 * self.a_size
        at, names = 0, self.marked
        for k in range(len(left)):
            end = at + a_many[k] + b_many[k]
            alignment = "".join([names[i] for i in marks[at:end].tolist()])[:-1]
            at = end
            if hashed:
                alignment = hashlib.sha256(alignment.encode()).hexdigest()
            lo, hi = cut[k], cut[k + 1]
            yield int(a_many[k]), int(b_many[k]), int(n_groups[k]), int(n_links[k]), alignment, pairs[lo:hi], count[lo:hi].astype(np.int64)


_LOADED: dict[tuple, Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for each Python worker and pair of files."""
    key = (a_path, b_path)
    if key not in _LOADED:
        _LOADED[key] = Aligner(a_path, b_path)
    return _LOADED[key]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))


def _align_task(a_path: str, b_path: str, hashed: bool, block_links: int):
    """Distinct texts to rows of :data:`STAGED`; a block's last row has no digest and the pairs' documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, block, held = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, []
        seen: list[tuple[np.ndarray, np.ndarray]] = []
        gathered = 0

        def summary() -> tuple:
            pairs, place = np.unique(np.concatenate([p for p, _ in seen]), return_inverse=True)
            times = np.zeros(len(pairs), np.int64)
            np.add.at(times, place, np.concatenate([n for _, n in seen]))
            return (block, None, 0, 0, 0, 0, None, pairs, times)

        def out(rows: list[tuple]) -> pa.RecordBatch:
            plain = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string()])]
            return pa.RecordBatch.from_arrays([*plain, _lists([r[7] for r in rows], pa.int32()), _lists([r[8] for r in rows], pa.int64())],
                                              names=[c.split()[0] for c in STAGED.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                texts, digests, many = (batch.column(k).slice(at, 128).to_pylist() for k in range(3))
                for digest, n, row in zip(digests, many, tool.align(texts, hashed), strict=True):
                    held.append((block, digest, *row))
                    seen.append((row[5], np.full(len(row[5]), n, np.int64)))
                    gathered += len(row[5])
                    if gathered >= block_links:
                        held.append(summary())
                        yield out(held)
                        held, seen, gathered, block = [], [], 0, block + 1
                if held:
                    yield out(held)
                    held = []
        if seen:
            yield out([summary()])

    return run


def _measure(texts: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's texts with the sums over their links, from the counts of the block's pairs."""
    texts = texts.combine_chunks()
    order = np.argsort(codes := counts["pair"].to_numpy())
    codes = codes[order]
    n, best = counts["n"].to_numpy()[order], counts["best"].to_numpy(zero_copy_only=False)[order]
    pairs = texts["pairs"].combine_chunks()
    sizes = pc.list_value_length(pairs).to_numpy(zero_copy_only=False)
    at = np.searchsorted(codes, pairs.flatten().to_numpy())
    times = texts["times"].combine_chunks().flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])

    def summed(values: np.ndarray) -> pa.Array:
        total = np.concatenate([[0], np.cumsum(values)])
        return pa.array(total[ends[1:]] - total[ends[:-1]], pa.int64())

    plain = texts.select(["digest", *MEASURES[:4], "alignment"])
    hit = n[at] if len(n) else times
    return plain.append_column("n_best", summed(times * (best[at] if len(n) else 0))).append_column("count_sum", summed(times * hit))


def align(df: DataFrame, a_path: str, b_path: str, text_col: str = "text", hashed: bool = False,
          block_links: int = BLOCK_LINKS) -> DataFrame:
    """``row``, the measures and ``alignment`` of every row of ``df``.

    ``n_a, n_b, n_groups, n_links`` count tokens, groups and links; ``n_best`` the links whose pair is the one that
    most documents hold among those of its A id, ties included; ``count_sum`` adds up the pairs' documents over the
    links. ``alignment`` lists the groups as ``a1,a2|b1;a3|b2,b3``, or is their SHA-256 if ``hashed``, so that only
    the digest is stored. Documents of which none has tokens are returned without any.
    """
    text = F.col(text_col)
    distinct = df.where(text != "").groupBy(text.alias("text")).agg(F.count(F.lit(1)).alias("many"))
    tokens = distinct.select("text", F.sha2("text", 256).alias("digest"), "many")
    staged = written(tokens.mapInArrow(_align_task(a_path, b_path, hashed, block_links), STAGED), "aligned")
    texts = staged.where("digest is not null")
    by_block = staged.where("digest is null").select("block", F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    by_block = by_block.select(F.col("block").alias("held_by"), F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    # as many rows as a vocabulary has ids at most for one id of the other
    b_size = F.lit(aligner(a_path, b_path).b_size)
    same = Window.partitionBy(F.floor(F.col("pair") / b_size))
    counts = by_block.groupBy("pair").agg(F.sum("times").alias("n"))
    counts = written(counts.withColumn("best", F.col("n") == F.max("n").over(same)), "aligned-pairs")
    met = by_block.select("held_by", "pair").join(counts, "pair")
    schema = "digest string, n_a long, n_b long, n_groups long, n_links long, alignment string, n_best long, count_sum long"
    found = written(texts.groupBy("block").cogroup(met.groupBy("held_by")).applyInArrow(_measure, schema), "aligned-texts")
    rows = df.select(F.struct("*").alias("row"))
    body = F.col("row")[text_col]
    keyed = rows.where(F.coalesce(body, F.lit("")) != "").withColumn("digest", F.sha2(body, 256)).join(found, "digest")
    none = rows.where(F.coalesce(body, F.lit("")) == "").select("row", *[F.lit(0).cast("long").alias(c) for c in MEASURES], F.lit("").alias("alignment"))
    return keyed.select("row", *MEASURES, "alignment").unionByName(none)
