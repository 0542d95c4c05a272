"""Packing: token sequences of a fixed size from documents, by bounded-space online best fit.

Each task reads its documents in turn and keeps at most ``open_windows`` open
windows. A document's full windows become sequences of their own; the rest goes
to the open window that it fills best. If it fits nowhere, the fullest window is
emitted (first topped up with the document's head if its gap is over
``max_waste``) and a new window opens. What is still open when a task ends is
merged by a second, small pass: leftovers are laid end to end and cut at the
window size; the last one of a task is cut at powers of two, which need no
padding. State is bounded by ``open_windows`` windows, whatever the input.

Rows: a null or empty text has the end id alone; a null document id stays null;
repeated rows are packed as often as they occur; other columns of the input are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import word_tokenizer

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
STAGED = PIECES + ", is_open boolean"
#: Sequence ids of the merging pass start here; those of the first are below.
MERGED = 1 << 61
#: Leftover ids that one merging task takes, about.
MERGE_TOKENS = 1 << 22
FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
          ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class Windows:
    """Open windows of one task; closed pieces gather in ``done``."""

    def __init__(self, size: int, most: int, waste: int, base: int):
        self.size, self.most, self.waste, self.next = size, most, waste, base
        self.used: list[int] = []
        self.held: list[list[tuple]] = []
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next, at))
            at += n
        self.next += 1

    def _close_fullest(self, k: int) -> None:
        self.used.pop(k)
        self._close(self.held.pop(k))

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        full, at = 4 * self.size, 0
        while len(ids) - at >= full:
            self._close([(doc, start + at // 4, ids[at: at + full], total)])
            at += full
        if at == len(ids):
            return
        ids, start = ids[at:], start + at // 4
        n = len(ids) // 4
        fits = [(u, k) for k, u in enumerate(self.used) if u + n <= self.size]
        if fits:
            u, k = max(fits)
        else:
            k = len(self.used)
            if k >= self.most:
                u, k = max((u, i) for i, u in enumerate(self.used))
                if (gap := self.size - u) > self.waste:
                    self.held[k].append((doc, start, ids[: 4 * gap], total))
                    ids, start = ids[4 * gap:], start + gap
                self._close_fullest(k)
                k = len(self.used)
            self.used.append(0)
            self.held.append([])
        self.held[k].append((doc, start, ids, total))
        self.used[k] += len(ids) // 4
        if self.used[k] == self.size:
            self._close_fullest(k)

    def leftovers(self) -> list[tuple]:
        """Pieces of the windows still open, with no place yet."""
        out = [(doc, start, len(ids) // 4, ids, total, self.next, 0) for w in self.held for doc, start, ids, total in w]
        self.used, self.held = [], []
        return out


class EndToEnd:
    """Fills one sequence after another to the brim; the last is cut at powers of two."""

    def __init__(self, size: int, base: int):
        self.size, self.next = size, base
        self.held: list[tuple] = []
        self.used = 0
        self.done: list[tuple] = []

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids) // 4, ids, total, self.next, at))
            at += len(ids) // 4
        self.next += 1

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        at = 0
        while at < len(ids):
            head = ids[at: at + 4 * (self.size - self.used)]
            self.held.append((doc, start + at // 4, head, total))
            self.used += len(head) // 4
            at += len(head)
            if self.used == self.size:
                self._close(self.held)
                self.held, self.used = [], 0

    def finish(self) -> None:
        pieces, rest = self.held, self.used
        while rest:
            want, now = 1 << (rest.bit_length() - 1), []
            rest -= want
            while want:
                doc, start, ids, total = pieces.pop(0)
                n = min(want, len(ids) // 4)
                now.append((doc, start, ids[: 4 * n], total))
                if 4 * n < len(ids):
                    pieces.insert(0, (doc, start + n, ids[4 * n:], total))
                want -= n
            self._close(now)


def _batch(rows: list[tuple], extra: list | None = None) -> pa.RecordBatch:
    fields = FIELDS + ([("is_open", pa.bool_())] if extra is not None else [])
    cols = [list(c) for c in zip(*rows, strict=True)] or [[] for _ in FIELDS]
    if extra is not None:
        cols.append(extra)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)],
                                      names=[n for n, _ in fields])


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
         window: int = 4096, open_windows: int = 64, max_waste: int = 32) -> DataFrame:
    """Pieces of documents with their place: columns of :data:`PIECES`; ``ids`` are little-endian 32-bit.

    Every id of every document lies in exactly one piece; offsets in a sequence
    are gapless from 0. One pass over the texts, written once with the ids;
    only leftovers are shuffled.
    """
    end = end_id.to_bytes(4, "little")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(tokenizer_path)
        state = Windows(window, open_windows, max_waste, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    state.add(doc, 0, ids + end, len(ids) // 4 + 1)
                for lo in range(0, len(state.done), 2048):
                    rows = state.done[lo: lo + 2048]
                    yield _batch(rows, [False] * len(rows))
                state.done = []
        if rest := state.leftovers():
            yield _batch(rest, [True] * len(rest))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = EndToEnd(window, MERGED + (TaskContext.get().partitionId() << 32))
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                state.add(*row)
            if state.done:
                yield _batch(state.done)
                state.done = []
        state.finish()
        if state.done:
            yield _batch(state.done)

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    staged = written(docs.mapInArrow(place, STAGED), "packed")
    left = staged.where("is_open")
    tokens = left.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-tokens // MERGE_TOKENS))
    # in a fixed order, so that a task that is run again after a loss cuts the same sequences
    spread = left.repartition(tasks, F.xxhash64("doc_id", "start", "sequence_id")).sortWithinPartitions(
        "sequence_id", "doc_id", "start", "ids")
    names = [n for n, _ in FIELDS]
    return staged.where("not is_open").select(*names).unionByName(spread.select(*names).mapInArrow(merge, PIECES))
