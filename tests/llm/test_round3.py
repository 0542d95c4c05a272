"""Alignment, sharding and periodic runs against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelforge.llm import alignment, common, queries, runs, sharding
from panelforge.llm.tokens import public_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, digest string, n_a string, key string, slot string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def _texts() -> list:
    r = random.Random(7)
    words = "the of Zorblat naïve 中文 don't x9 ... ∑ éé́ <s> <|endoftext|>  ".split(" ")
    prose = [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(25)]
    turn = " ".join(["one two three four five"] * 9)
    out = [None, "", " ", "\n\t ", "a▁b", "x" * 3000, "ab " * 900, turn, "head " + turn + " one tail", *prose, prose[0], prose[0], prose[0]]
    return out + ["A\rb\r\nc", "  two  blanks  ", "　wide", "zero\x00byte", "🙂🙂 👨‍👩‍👧"]


@pytest.fixture(scope="module")
def rows():
    out = [(k * 7 if k % 9 else None, t, "en", "a", 0, *["clash"] * 5) for k, t in enumerate(_texts())]
    return out + out[8:10]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ready(spark)
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture()
def table(spark, docs, none, tmp_path):
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    return tmp_path


# alignment

def _tokens(text):
    """Ids of both sides, by the plain calls that the contract names; none if the bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_vocabulary(A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_vocabulary(B))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in plain}
    back |= {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
    if not text:
        return [], []
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[1:-1], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    same = b"".join(x for _, x in left) == raw == b"".join(x for _, x in right)
    return (left, right) if same else ([], [])


def _groups(text):
    left, right = _tokens(text)

    def ended(side):
        at, out = 0, []
        for i, raw in side:
            at += len(raw)
            out.append((at, i))
        return out

    left, right, out, lo = ended(left), ended(right), [], 0
    for end in sorted({e for e, _ in left} & {e for e, _ in right}):
        out.append(([i for e, i in left if lo < e <= end], [i for e, i in right if lo < e <= end]))
        lo = end
    return len(left), len(right), out


@pytest.fixture(scope="module")
def brute_alignment(rows):
    groups = {t: _groups(t) for t in {r[1] for r in rows}}
    links = {t: [(x, y) for a, b in g for x in a for y in b] for t, (_, _, g) in groups.items()}
    count = Counter(pair for r in rows for pair in set(links[r[1]]))
    top: dict = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    out = []
    for r in rows:
        n_a, n_b, g = groups[r[1]]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        all_links = links[r[1]]
        out.append((r[0], n_a, n_b, len(g), len(all_links), sum(count[p] == top[p[0]] for p in all_links), sum(count[p] for p in all_links), text))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_alignment_equals_brute_force(docs, brute_alignment, block):
    got = alignment.align(docs, public_vocabulary(A), public_vocabulary(B), block_links=block)
    got = got.select("row.doc_id", *alignment.MEASURES, "alignment").collect()
    assert sorted(map(tuple, got), key=str) == brute_alignment


def test_alignment_query_hashes_the_groups(spark, table, brute_alignment):
    got = queries.REGISTRY["op11_cross_alignment"](spark, f"{table}/full").collect()
    want = [(*x[:-1], hashlib.sha256(x[-1].encode()).hexdigest() if x[-1] else "") for x in brute_alignment]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_alignment_counts_large_groups_by_pair(monkeypatch):
    tool = alignment.Aligner(public_vocabulary(A), public_vocabulary(B))
    texts = ["🙂🙂 中文 éé", "plain words", "👨‍👩‍👧 ∑∑"]
    plain = tool.align(texts)
    monkeypatch.setattr(alignment, "LISTED", 1)
    for x, y in zip(plain, tool.align(texts), strict=True):
        assert x[:5] == y[:5] and x[5].tolist() == y[5].tolist() and x[6].tolist() == y[6].tolist()


def test_long_texts_align():
    tool = alignment.Aligner(public_vocabulary(A), public_vocabulary(B))
    word, blank, many = "ab" * 200_000, "x" + " " * 100_000, "the end of it all " * 50_000
    (n_a, _, _, _, groups, *_), _, (m_a, m_b, *_) = tool.align([word, blank, many])
    assert n_a > 1000 and groups.count(";") > 1000 and m_a == m_b > 200_000


# sharding

def _check_shards(got, rows, shards, size_of, spread):
    assert sorted((str(r.row.doc_id), str(r.row.text)) for r in got) == sorted((str(r[0]), str(r[1])) for r in rows)
    total = [0] * shards
    for s in range(shards):
        mine = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        total[s] = sum(r.size for r in mine)
    assert all(r.size == size_of(r.row.text) for r in got)
    mean = sum(total) / shards
    assert all(abs(t - mean) <= spread * mean + max(r.size for r in got) for t in total)
    # a text's copies lie in neighbouring shards, none of them left out
    held: dict = {}
    for r in got:
        held.setdefault(r.row.text, set()).add(r.shard)
    assert all(max(x) - min(x) + 1 >= len(x) for x in held.values())
    assert sum(len(x) > 1 for x in held.values()) <= shards - 1
    return total


@pytest.mark.parametrize("shards, piece", [(1, 1 << 20), (5, 1 << 20), (5, 300), (24, 200)])
def test_shards_are_even_and_whole(docs, rows, shards, piece):
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    got = sharding.shard_rows(docs, shards, size, "text", "doc_id", piece_bytes=piece).collect()
    _check_shards(got, rows, shards, lambda t: len((t or "").encode()) + 8, 0.01)


def test_a_third_of_equal_rows_is_split(spark):
    rows = [(1, "same text")] * 400 + [(k, f"text {k}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_rows(df, 8, F.octet_length("text") + 8, "text", "doc_id").collect()
    total = _check_shards(got, rows, 8, lambda t: len(t) + 8, 0.002)
    assert max(total) - min(total) <= 40


def test_a_row_larger_than_a_shard(spark):
    rows = [(0, "x" * 100_000)] + [(k, "short") for k in range(1, 60)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 4, F.octet_length("text") + 8, "text", "doc_id").collect()
    _check_shards(got, rows, 4, lambda t: len(t) + 8, 1.0)


def test_cuts_are_exact_counts(spark):
    r = random.Random(2)
    keys = sorted({r.randrange(1 << 30) << (8 * r.randrange(20)) for _ in range(3000)})
    sizes = [r.randint(1, 50) for _ in keys]
    df = spark.createDataFrame([(bytearray(k.to_bytes(24, "big")), s) for k, s in zip(keys, sizes)], "key binary, size long").repartition(3)
    cuts = sharding.splitters(df, sum(sizes), 7, 1, 1e-9)
    for j, cut in enumerate(cuts, 1):
        at = int.from_bytes(cut, "big")
        below = sum(s for k, s in zip(keys, sizes) if k < at)
        assert abs(below - sum(sizes) * j / 7) <= 25  # half of the largest row


def test_shards_are_written(docs, rows, tmp_path, spark):
    sharded = sharding.shard_rows(docs.select("doc_id", "text"), 3, F.lit(1), "text", "doc_id")
    sharding.write_shards(sharded, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2}


# periodic runs

def _brute_runs(words, least):
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        k = 0
        while k + p < n:
            if words[k] != words[k + p]:
                k += 1
                continue
            s = k
            while k + p < n and words[k] == words[k + p]:
                k += 1
            e = k + p
            if e - s >= max(least, 2 * p) and not any(words[s: e - q] == words[s + q: e] for q in range(1, p)):
                out.append((s, e - s, p))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_equal_brute_force():
    r = random.Random(4)
    for _ in range(1500):
        least, kinds, n = r.choice([2, 3, 5, 12]), r.choice([1, 2, 3, 6, 20]), r.randint(0, 60)
        words = [r.randrange(kinds) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            at, part = r.randint(0, n), [r.randrange(kinds) for _ in range(r.randint(1, 8))]
            words[at:at] = (part * 30)[: r.randint(0, 25)]
        assert [tuple(x) for x in runs.runs_of(words, least).tolist()] == _brute_runs(words, least), (least, words)


def test_suffix_tree_extensions():
    r = random.Random(5)
    for _ in range(60):
        word = [*[r.randint(1, 3) for _ in range(r.randint(1, 40))], 0]
        ext = runs.Extension(word)
        leaves, _ = ext.tree.tour()
        assert [word[k:] for k in leaves] == sorted(word[k:] for k in range(len(word)))
        back, _ = ext.tree.tour(backwards=True)
        flip = [4 - x if x else 0 for x in word]
        assert [flip[k:] for k in back] == sorted(flip[k:] for k in range(len(flip)))
        pairs = [(i, j) for i in range(len(word)) for j in range(len(word)) if i != j]
        want = [next((k for k in range(len(word)) if word[i + k: i + k + 1] != word[j + k: j + k + 1]), 0) for i, j in pairs]
        import numpy as np
        assert ext.lce(np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])).tolist() == want if pairs else True


def test_long_texts_have_runs():
    words = list(range(500)) * 120
    assert runs.runs_of(words).tolist() == [[0, 60_000, 500]]
    assert runs.runs_of(["a"] * 60_000).tolist() == [[0, 60_000, 1]]


def _wanted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = _brute_runs(words, 12)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_query_equals_brute_force(spark, docs, rows, tmp_path):
    more = [(k, *r[1:]) for k, r in enumerate(rows * 4)]
    spark.createDataFrame(rows + more, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.REGISTRY["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((_wanted(r[0], r[1]) for r in rows + more), key=str)
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(len(more))) > 5


@pytest.mark.parametrize("name", ["op11_cross_alignment", "op12_sharding", "op13_periodic_runs"])
def test_empty_tables_give_empty_results(spark, table, name):
    full, empty = (queries.REGISTRY[name](spark, f"{table}/{k}") for k in ("full", "empty"))
    assert empty.collect() == [] and empty.dtypes == full.dtypes and full.count() > 0
