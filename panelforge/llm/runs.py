"""Periodic runs in word sequences: suffix-tree LCE on a text and its reversal, Lyndon-root candidates extended both ways.

A run is a stretch of words with smallest period q that no neighbouring word
extends and that is long enough. Every run holds, for one of the two orders of
the words, a position whose longest Lyndon word is the run's root; that word
ends where the next smaller suffix begins. So each position gives two
candidates, and each is extended as far as the words agree: to the right by the
longest common extension of the text, to the left by that of its reversal.

Both come from Ukkonen's suffix tree. The Euler tour is kept where it returns to
a node between two of its children, which is once between neighbouring leaves;
the least depth there is the depth of the leaves' lowest common ancestor, read
in constant time from a sparse table. The tour also gives the order of the
suffixes, in both orders of the words.

In a run of ``least`` words or more with two periods or more, each word is part
of ``ceil(least / 2)`` consecutive words that occur twice in the text. Stretches
without any such are no part of a run, and stand in the trees as one separator
that differs from all else. No run is lost and none is longer for it.

A text is the unit of work: rows are never shuffled. A worker holds one text and
its trees, about 500 bytes for each word that is no separator.

Rows: a null or empty text has no words, no runs and an empty collapsed text;
other columns pass through in ``row`` whatever their names; repeated rows
repeat; an empty table gives an empty result. Runs that tie in start are ordered
by period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Odd multiplier of rolling hashes.
STEP = np.uint64(0x9E3779B97F4A7C15)
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                      T.StructField("collapsed", T.StringType())])
ARROW = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))),
                   ("collapsed", pa.string())])


class SuffixTree:
    """Ukkonen's tree of ``word``, whose last symbol is 0 and occurs nowhere else; edges are keyed by node and symbol."""

    def __init__(self, word: list[int]):
        self.n, self.width = len(word), max(word) + 1
        self.start, self.end, self.edge = [0], [0], {}
        self._grow(word)

    def _grow(self, word: list[int]) -> None:
        n, width, edge, start, end, link = self.n, self.width, self.edge, self.start, self.end, [0]
        node = length = at = waiting = 0
        for i, symbol in enumerate(word):
            waiting += 1
            last = 0
            while waiting:
                if not length:
                    at = i
                key = node * width + word[at]
                below = edge.get(key)
                if below is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last] = node
                    last = node
                else:
                    top = start[below]
                    span = (end[below] if end[below] <= i else i + 1) - top
                    if length >= span:
                        node, at, length = below, at + span, length - span
                        continue
                    if word[top + length] == symbol:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    inner = len(start)
                    edge[key] = inner
                    start += (top, i)
                    end += (top + length, n)
                    link += (0, 0)
                    start[below] = top + length
                    edge[inner * width + word[top + length]] = below
                    edge[inner * width + symbol] = inner + 1
                    if last:
                        link[last] = inner
                    last = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    at = i - waiting + 1

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in their order (in that of the reversed alphabet if ``backwards``; 0 is least in both), and the depth
        at which the tour turns before each leaf, which is that of its lowest common ancestor with the leaf before."""
        key = np.fromiter(self.edge.keys(), np.int64, len(self.edge))
        child = np.fromiter(self.edge.values(), np.int64, len(self.edge))
        parent, symbol = key // self.width, key % self.width
        if backwards:
            symbol = np.where(symbol, self.width - symbol, 0)
        order = np.argsort(parent * (self.width + 1) + symbol)
        kids = child[order].tolist()
        first = np.searchsorted(parent[order], np.arange(len(self.start) + 1)).tolist()
        span = (np.array(self.end) - np.array(self.start)).tolist()
        nodes, depths, turns, leaves, lows, turn = [0], [0], [-1], [], [], 0
        while nodes:
            node, depth, t = nodes.pop(), depths.pop(), turns.pop()
            if t >= 0:
                turn = t
            lo, hi = first[node], first[node + 1]
            if lo == hi:
                leaves.append(self.n - depth)
                lows.append(turn)
                continue
            for k in range(hi - 1, lo - 1, -1):
                c = kids[k]
                nodes.append(c)
                depths.append(depth + span[c])
                turns.append(depth if k > lo else -1)
        return np.array(leaves), np.array(lows, np.int32)


class Extension:
    """Longest common extensions of suffixes of ``word`` (which ends in its own 0), many at a time."""

    def __init__(self, word: list[int]):
        self.tree = SuffixTree(word)
        leaves, lows = self.tree.tour()
        self.rank = _ranks(leaves)
        self.least = [lows]
        while 2 * (wide := 1 << (len(self.least) - 1)) <= len(lows):
            top = self.least[-1]
            self.least.append(np.minimum(top[:-wide], top[wide:]))

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common words from positions ``i`` and ``j`` on; the positions of a pair differ."""
        a, b = self.rank[i], self.rank[j]
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b)
        out = np.zeros(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] + 1 - (1 << int(k))])
        return out


def _ranks(leaves: np.ndarray) -> np.ndarray:
    rank = np.empty(len(leaves), np.int64)
    rank[leaves] = np.arange(len(leaves))
    return rank


def _next_smaller(rank: list[int], n: int) -> np.ndarray:
    """For each of the first ``n`` suffixes where the next smaller one begins, ``n`` if none does."""
    out, waiting = [n] * n, []
    for i in range(n):
        r = rank[i]
        while waiting and rank[waiting[-1]] > r:
            out[waiting.pop()] = i
        waiting.append(i)
    return np.array(out)


def _repeats(ids: np.ndarray, gram: int) -> np.ndarray:
    """Whether each word lies in ``gram`` consecutive words that occur twice (or whose hashes agree by chance)."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * STEP
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(len(ids) - gram + 1, np.uint64)
    for k in range(gram):
        hashes = hashes * STEP + mixed[k: k + len(hashes)]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes) + 1, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    change[:len(hashes)] += twice[:-1]
    change[gram: gram + len(hashes)] -= twice[:-1]
    return np.cumsum(change[:-1]) > 0


def runs_of(words: list, least: int = 12) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of at least ``least`` words and two periods, by start and period."""
    none = np.zeros((0, 3), np.int64)
    if len(words) < least:
        return none
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words])
    inside = _repeats(ids, -(-least // 2))
    if not inside.any():
        return none
    # words that may be in a run, and the first of every stretch that is not as a separator of its own
    held = np.flatnonzero(inside | np.append(False, inside[:-1]))
    part = ids[held]
    apart = ~inside[held]
    part[apart] = len(known) + np.arange(apart.sum())
    n = len(held)
    part = np.unique(part, return_inverse=True)[1] + 1
    ahead = Extension([*part.tolist(), 0])
    back = Extension([*part[::-1].tolist(), 0])
    found = []
    i = np.arange(n)
    for rank in (ahead.rank, _ranks(ahead.tree.tour(backwards=True)[0])):
        j = _next_smaller(rank.tolist(), n)
        right = ahead.lce(i, j)  # suffix n is the closing 0, common with none
        left = back.lce(n - i, n - j)  # the words before i and before j, read backwards; none before the first
        start, end, period = i - left, j + right, j - i
        long = (end - start >= 2 * period) & (end - start >= least)
        found.append(np.stack([start, end - start, period], 1)[long])
    out = np.unique(np.concatenate(found), axis=0)
    out[:, 0] = held[out[:, 0]]
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapse(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _found(text: Column, least: int) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            words = (t.as_py() or "").encode().split()
            runs = runs_of(words, least)
            listed = [{"start": s, "length": m, "period": p} for s, m, p in runs.tolist()]
            out.append({"n_words": len(words), "runs": listed, "collapsed": b" ".join(collapse(words, runs)).decode()})
        return pa.array(out, ARROW)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # marked so that it is evaluated once and never moved into the expressions that read its result
    return F.arrow_udf(run, FOUND).asNondeterministic()(text)


def periodic_runs(df: DataFrame, text: Column | str = "text", least: int = 12) -> DataFrame:
    """``row, n_words, runs, collapsed`` of every row of ``df``.

    ``runs`` lists all runs of at least ``least`` words and two periods as ``start, length, period`` in words, by start
    and period. ``collapsed`` is the text with each run cut down to its first period, words joined by a space.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = df.select(F.struct("*").alias("row"), _found(text.cast("string"), least).alias("found"))
    return found.select("row", "found.n_words", "found.runs", "found.collapsed")
