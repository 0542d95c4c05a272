"""The training-data operators against brute force, on small tables with odd rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import common, components, language_id, line_dedup, mixing, nn_descent, packing, pii, quality, reputation, simhash, substring
from panelforge.llm.tokens import WordTokenizer, public_vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, row string"
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mu."]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    long = "\n".join(prose(100 + i, 40) for i in range(60))
    near = prose(1, 300)
    lines = "one line here\ntwo lines here\nthree lines here\nfour lines"
    out = [(1, near, "en", "a"), (2, near + " tail", "en", "a"), (3, near, "de", "b"), (4, long, "en", "a"), (5, "", None, None),
           (6, None, "en", None), (7, "x y", "fr", "b"), (8, lines, "en", "a"), (9, "before\n" + lines + "\nafter", "en", "b"),
           (None, near, "en", "a"), (1, near, "en", "a"), (10, "###", "en", "c"), (11, long[500:4000], "en", "a")]
    return [(i, t, g, s, 0, "clash", "clash") for i, t, g, s in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    common.ready(spark)
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_tokenizer_equals_the_plain_one():
    t, r = WordTokenizer(public_vocabulary("word_bpe_49k.json"), words=50), random.Random(3)
    parts = list("aAbéÉßİΣςſ'sStm.,!|<>%_- \t\n\x0b\x1c\x85\xa0 ́中🙂0²½") + ["<|endoftext|>", "'LL ", "", " "]
    for _ in range(300):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == t._plain(text), repr(text)


@pytest.mark.parametrize("size", [16, 4096])
def test_packing_round_trip(docs, none, rows, size):
    path = public_vocabulary("word_bpe_49k.json")
    t = WordTokenizer(path)
    got = packing.pack(docs, path, window=size, open_windows=3, max_waste=2).collect()
    want = sorted((str(i), t.encode([x])[0] + (2).to_bytes(4, "little")) for i, x, *_ in rows)
    by_doc: dict = {}
    for p in got:
        assert p.length * 4 == len(p.ids) and p.length > 0
        by_doc.setdefault((str(p.doc_id), p.doc_tokens), []).append(p)
    assert sum(p.length for p in got) == sum(len(x) // 4 for _, x in want)
    for (doc, n), pieces in by_doc.items():
        texts = {x for i, x in want if i == doc and len(x) // 4 == n}
        assert len(texts) == 1
        whole = texts.pop()
        assert all(bytes(p.ids) == whole[4 * p.start: 4 * (p.start + p.length)] for p in pieces)
        times = sum(1 for i, x in want if i == doc and len(x) // 4 == n)
        covered = np.zeros(n, int)
        for p in pieces:
            covered[p.start: p.start + p.length] += 1
        assert (covered == times).all()
    by_seq: dict = {}
    for p in got:
        by_seq.setdefault(p.sequence_id, []).append(p)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    assert packing.pack(none, path).count() == 0


def test_language(spark, docs, none):
    from pyspark.sql import functions as F

    common.ready(spark)
    en, de = "the and of with that this from have ", "der die und nicht ist ein auch sich "
    table = [(i, (en if i % 2 else de) * (3 + i % 5), "en" if i % 2 else "de", f"h{i % 4}.org") for i in range(60)]
    table += [(100, en * 3, "de", "h1.org"), (101, None, "en", None), (102, "12 34 %%", "en", None), (103, "жщыэ юяъь " * 9, None, None)]
    df = spark.createDataFrame(table, "id long, text string, lang string, host string")
    got = {r.id: r for r in language_id.identify(df, F.col("text"), F.col("lang"), address=F.lit("org"), host=F.col("host")).select(
        "row.id", "lang", "kept", "posterior").collect()}
    assert all(got[i].lang == ("en" if i % 2 else "de") and got[i].kept for i in range(60))
    assert got[100].lang == "en" and not got[101].kept and not got[102].kept and not got[103].kept and len(got) == 64
    assert language_id.identify(docs, F.col("text"), F.col("lang"), host=F.col("source")).count() == 13
    assert language_id.identify(none, F.col("text"), F.col("lang"), host=F.col("source")).count() == 0


def test_a_small_language_has_a_model_in_a_large_corpus(spark):
    common.ready(spark)
    small = F.col("id") < 9
    rows = spark.range(12_000).select(
        F.when(small, F.concat(F.lit("der die und nicht ist "), F.col("id"))).otherwise(F.concat(F.lit("the and of with "), F.col("id"))).alias("text"),
        F.when(small, "de").otherwise("en").alias("declared"))
    langs, model = language_id.fit(rows, 1000)
    assert langs == ["de", "en"] and np.allclose(np.exp(model.astype(float)).sum(axis=1), 1, atol=1e-3)


def test_vectors(spark):
    common.ready(spark)
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 16))
    x = [centres[i % 12] + 0.08 * r.standard_normal(16) for i in range(240)] + list(r.standard_normal((100, 16)))
    x += [x[0], x[0]]
    table = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (1005, [float("inf")] * 16),
           (1006, [1.0, 2.0]), (None, table[1][1])]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(df, tables=8).collect()}
    unit = np.array([v / np.linalg.norm(v) for v in x + [x[1]]])
    near = unit @ unit.T >= 0.9
    ids = [*range(len(x)), None]
    assert [got[i].n_links for i in ids] == (near.sum(1) - 1).tolist()
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(1000, 1007))
    reach = near.copy()
    for _ in range(9):
        reach = reach @ reach
    assert [got[i].component_id for i in ids] == [min(j for j in np.flatnonzero(row) if j < len(x)) for row in reach]
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_links_between_saturated_groups_are_not_lost(spark):
    common.ready(spark)
    r = np.random.default_rng(7)
    dim, x = 64, []
    for pair in range(3):
        one, two = np.linalg.qr(r.standard_normal((dim, 2)))[0].T
        for centre in (one, 0.95 * one + np.sqrt(1 - 0.95 ** 2) * two):
            for _ in range((14, 40, 90)[pair]):
                noise = r.standard_normal(dim)
                x.append(centre + 0.1 * noise / np.linalg.norm(noise))
    unit = np.array([v / np.linalg.norm(v) for v in x])
    near = unit @ unit.T >= 0.9
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(unit)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) - 1).tolist()
    assert {got[i].component_id for i in range(len(x))} == {0, 28, 108}


def test_audit_sees_missed_links_of_small_pairs(spark, monkeypatch):
    common.ready(spark)
    r = np.random.default_rng(9)
    heap = r.standard_normal(32)
    x = [heap + 0.05 * r.standard_normal(32) for _ in range(60)]
    x += [v for c in r.standard_normal((30, 32)) for v in (c, c + 0.05 * r.standard_normal(32))]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, vec array<double>")
    counted = spark.createDataFrame([(i, 59 if i < 60 else 0) for i in range(120)], "node long, pairs long")
    assert nn_descent.audit(nodes, counted, 0.9, 1024, 10) == 0.0
    monkeypatch.setattr(nn_descent, "audit", lambda *args: 0.5)
    with pytest.raises(RuntimeError, match="0.5000"):
        nn_descent.near_vectors(nodes.withColumnsRenamed({"node": "vec_id", "vec": "embedding"}), tables=1, rounds=0, attempts=1)


def test_pii(spark, docs, none):
    r = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "x@y.z@q.r", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111", " ", "-", ".", "+49 (30) 1234567",
             "+1", "007", "é", "٣", "://u:p@h/", "0" * 30, "%+"]
    luhn = pii.luhn
    rules = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(n := re.sub("[ -]", "", m)) <= 19 and luhn(n)),
             (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]
    assert luhn("4111111111111111") and not luhn("4111111111111112")
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        want = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m[0]))
        assert [x for x in pii.spans(text) if x[1] < pii.BASE] == want, repr(text)
    assert (14, 5, 41) in pii.spans("Account IBAN: DE89 3704 0044 0532 0130 00 x")
    assert [x[1] for x in pii.spans("https://bob:pw@h.de/")][-1:] == [4] or any(x[1] == 4 for x in pii.spans("https://bob:pw@h.de/"))
    common.ready(spark)
    assert pii.find_pii(docs).count() == 13 and pii.find_pii(none).count() == 0


def test_line_dedup(spark, docs, none):
    common.ready(spark)
    got = {(r.doc_id, r.text): r for r in line_dedup.dedup_lines(docs).select("row.doc_id", "text", "n_removed", "n_lines", "row._k1").collect()}
    nine = [r for (i, _), r in got.items() if i == 9][0]
    assert nine.text == "before\nafter" and nine.n_removed == 4 and nine.n_lines == 6 and nine._k1 == "clash"
    assert [r.n_removed for (i, _), r in got.items() if i == 8] == [0] and (6, None) in got and (5, "") in got
    assert line_dedup.dedup_lines(docs).count() == 13 and line_dedup.dedup_lines(none).count() == 0


def _print(text: str) -> int:
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, none, rows):
    common.ready(spark)
    for _, text, *_ in rows:
        assert simhash.fingerprint(text) % (1 << 64) == _print(text)
    found = simhash.near_duplicates(docs).collect()
    fps = {str(i): _print(t) for i, t, *_ in rows}
    for r in found:
        linked = [int(i) for i, f in fps.items() if i != "None" and bin(f ^ r.fp % (1 << 64)).count("1") <= 3]
        assert r.component_id <= min(linked)
    kept = simhash.keep_one(docs).collect()
    assert len([r for r in kept if r.doc_id == 1]) == 1 and not any(r.doc_id in (3, None) for r in kept)
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_simhash_links_are_all_pairs_within_three_bits(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << i for i in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(12)} | {0, (1 << 64) - 1}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = {(a, b) for (a,) in df.collect() for (b,) in df.collect() if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3}
    got = [tuple(x) for x in simhash.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(tuple(x) for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert all(got.get(x, x) == find(x) for x in parent)


def test_words_are_counted_as_split_does(spark):
    texts = [None, "", " ", "a", " a ", "a b", "\ta\n\nb \x0b\x0c\rc\n", "x " * 5000, "\u00a0a\u3000b c", "\U0001f600 \U0001f600", "\n\n", "a\x1cb c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(mixing.count_words(F.col("text")).alias("n")).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


def test_mixing(spark, docs, none):
    table = [(i, prose(i, 20), "big" if i < 300 else f"s{i % 3}") for i in range(360)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string")
    got = mixing.mix(df, max_repeats=2.0).select("row.source", "tokens", "copies", "epochs", "weight").collect()
    total, real = {}, {}
    for r in got:
        assert r.tokens == 20 and r.copies >= 1
        total[r.source] = total.get(r.source, 0) + r.tokens
        real[r.source] = real.get(r.source, 0) + r.tokens * r.copies
    assert abs(real["big"] / total["big"] - 1) < 1e-9
    assert all(abs(real[s] - 2 * total[s]) <= 20 for s in ("s0", "s1", "s2"))
    shares = mixing.mix(df, max_repeats=None, target_entropy=1.0).select("row.source", "weight").distinct().collect()
    w = np.array([r.weight for r in shares])
    assert abs(w.sum() - 1) < 1e-9 and abs(-(w * np.log(w)).sum() - 1.0) < 1e-6
    half = mixing.mix(df, max_repeats=2.0, budget=2000).select("tokens", "copies").collect()
    assert abs(sum(r.tokens * r.copies for r in half) - 2000) <= 4 * 20
    assert mixing.mix(docs).count() == 13 and mixing.mix(none).count() == 0


def test_substring(spark, docs, none):
    common.ready(spark)
    shared, other = prose(50, 80), prose(51, 90).split()
    fuzzy = [w if i % 30 else "changed" for i, w in enumerate(other, 5)]
    table = [(1, prose(60, 200) + " " + shared + " " + prose(61, 50)), (2, prose(62, 20) + " " + shared), (3, " ".join(other) + " " + prose(63, 70)),
             (4, prose(64, 33) + " " + " ".join(fuzzy)), (5, prose(65, 400)), (6, prose(65, 400)), (7, None), (8, "short text"), (None, shared)]
    table += [(100 + i, prose(500 + i, 30) + " " + prose(49, 60)) for i in range(40)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = substring.passages(df).collect()
    pairs = {(r.ref_id, r.doc_id, r.kind) for r in got}
    assert (1, 2, "passage") in pairs and (3, 4, "passage") in pairs and (5, 6, "copy") in pairs
    two = next(r for r in got if (r.ref_id, r.doc_id) == (1, 2))
    assert (two.ref_start, two.ref_end, two.start, two.end, two.matches) == (200, 280, 20, 100, 80)
    named = {x for r in got for x in (r.ref_id, r.doc_id)}
    assert named == {1, 2, 3, 4, 5, 6, *range(100, 140)}
    assert len([r for r in got if r.doc_id >= 100]) < 3 * 40
    assert substring.passages(docs).count() >= 3 and substring.passages(none).count() == 0


def test_chain_is_the_best_one():
    r = random.Random(6)
    for _ in range(60):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randint(2, 12))})
        a, b = np.array([p for p, _ in pts]), np.array([q for _, q in pts])
        score = []
        for i, (x, y) in enumerate(pts):
            before = [score[j] - substring.GAP * (x - pts[j][0] + y - pts[j][1]) for j in range(i) if pts[j][0] < x and pts[j][1] < y]
            score.append(substring.K + max([0, *before]))
        best = substring.chain(a, b, least=1)[0]
        got = sum(substring.K for _ in best) - substring.GAP * sum(a[q] - a[p] + b[q] - b[p] for p, q in zip(best, best[1:]))
        assert abs(got - max(score)) < 1e-9


def test_chain_goes_on_behind_a_gap_too_wide():
    at = np.array([*range(0, 52, 6), *range(180, 232, 6)])
    assert sorted(c.tolist() for c in substring.chain(at, at, least=2)) == [list(range(9)), list(range(9, 18))]


def test_alignment_is_cut_at_a_bad_gap():
    one, two = prose(80, 60).split(), prose(81, 60).split()
    at, k = [0, 20, 40, 52], substring.K
    for gap_y in (prose(83, 60).split(), []):
        gap_x, far = prose(82, 60).split(), 60 + len(gap_y)
        x, y = [*one, *gap_x, *two], [*one, *gap_y, *two]
        got = substring.align(x, y, at + [120 + p for p in at], at + [far + p for p in at], k)
        assert [(s, e, t, f) for s, e, t, f, m in got if m >= 60] == [(0, 60, 0, 60), (120, 180, far, far + 60)]
    assert substring.align([*one, "x", *two], [*one, "y", *two], at + [61 + p for p in at], at + [61 + p for p in at], k) == [(0, 121, 0, 121, 120)]


def test_every_document_but_the_first_is_a_repeat(spark):
    common.ready(spark)
    shared = prose(90, 80)
    table = [(i, prose(1000 + i, 30) + " " + shared + " " + prose(2000 + i, 30)) for i in range(30)]
    got = substring.passages(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in got} == set(range(1, 30)) and all(r.ref_id < r.doc_id for r in got)


def test_nested_passages_do_not_hide_the_whole_one(spark):
    common.ready(spark)
    table = []
    for i in range(0, 80, 4):
        shared = prose(3000 + i, 52).split()
        parts = (shared, shared[:35], shared[17:], shared)
        table += [(i + j, " ".join([prose(4000 + i + j, 30), *p, prose(5000 + i + j, 30)])) for j, p in enumerate(parts)]
    got = substring.passages(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {(r.ref_id, r.doc_id) for r in got} == {(i, i + 3) for i in range(0, 80, 4)}


def test_passages_with_one_word_in_five_changed_are_found(spark):
    common.ready(spark)
    r, table, want = random.Random(12), [], set()
    for i in range(0, 120, 2):
        one = [f"w{r.randrange(10**6)}" for _ in range(60)]
        spots = set(range(3, 60, 5)) if i % 4 else set(r.sample(range(2, 58), 11))
        two = [f"x{r.randrange(10**6)}" if j in spots else x for j, x in enumerate(one)]
        table += [(i, " ".join([prose(6000 + i, 40), *one, prose(7000 + i, 40)])), (i + 1, " ".join([prose(8000 + i, 40), *two, prose(9000 + i, 40)]))]
        want.add((i, i + 1))
    got = substring.passages(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()
    assert {(r.ref_id, r.doc_id) for r in got} == want


def test_urls(spark):
    from pyspark.sql import functions as F

    urls = ["http://A.example.net/en/1?q#f", "https://x.example.net?q=/en/", "http://b.example.com/de/x#y", "http://c.org/fr/", None, "no scheme/x", "ftp://h",
            "http://sub.bad.info/a", "http://sub.bad.info/b", "http://ok.info/c", "http://example.network/en/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://sub.bad.info/") for i in range(40)]
                                  + [(200 + i, "http://ok.info/") for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(1, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in reputation.filter_urls(pages, labels).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][:3] == ("x.example.net", "", None)
    assert got[2] == ("b.example.com", "/de/x", "example.com/de/", "block") and got[3] == ("c.org", "/fr/", "org/fr/", "allow")
    assert got[4][:3] == ("", "", None) == got[5][:3] and got[6][:3] == ("h", "", None) and got[10][2] is None
    assert got[7][3] == "block" and got[9][3] == "allow" and len(got) == len(urls) + 80
    for a, b, x in ((2.0, 3.0, 0.4), (50.5, 2.5, 0.9), (0.3, 7.0, 0.01)):
        t = (np.arange(200000) + 0.5) / 200000
        d = t ** (a - 1) * (1 - t) ** (b - 1)
        assert abs(reputation.beta_cdf(x, a, b) - d[t < x].sum() / d.sum()) < 2e-2
    assert reputation.filter_urls(pages.limit(0), labels).count() == 0
    assert reputation.filter_urls(pages, labels.limit(0)).where(F.col("rule").isNull() & (F.col("verdict") == "block")).count() == 0


def test_quality(spark, docs, none):
    from math import comb

    from pyspark.sql import functions as F

    tails = spark.range(1).select(*[quality.binomial_tail(F.lit(k), F.lit(n), p).alias(f"t{i}") for i, (k, n, p) in
                                    enumerate([(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.03)])]).first()
    for t, (k, n, p) in zip(tails, [(0, 10, 0.1), (3, 50, 0.02), (7, 400, 0.03)]):
        assert abs(t - sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))) < 1e-9
    table = [(i, prose(i, 80) + (" ### $$$ %%% &&&" * 20 if i % 10 == 0 else ""), "en") for i in range(4000)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1) for i in range(4000)], "doc_id long, quality int")
    got = quality.filter_quality(df, labels).collect()
    assert all(r.kept == (r.doc_id % 10 != 0) for r in got if not r.base_failed) and len(got) == 4000
    labels2 = labels.select("doc_id", "quality")
    assert quality.filter_quality(docs, labels2).count() == 13 and quality.filter_quality(none, labels2).count() == 0


def test_repeat_words_against_counting(spark):
    from collections import Counter

    r = random.Random(9)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 25))) for _ in range(200)] + [None, "", "a b c a b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", *quality.measures(
        __import__("pyspark").sql.functions.col("text"))).select("i", "_w.n_repeat_words").collect()
    for row in df:
        w = (texts[row.i] or "").split()
        c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        want = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert row.n_repeat_words == len(want)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as P

    from tests.conftest import SF_SMOKE
    docs = spark.read.parquet(f"{SF_SMOKE}/documents.parquet")
    one = P.language_stage(spark, docs, SF_SMOKE)
    assert one.columns == docs.columns and one.count() >= 0.99 * docs.count()
    three = P.simhash_stage(spark, one, SF_SMOKE)
    four = P.mixing_stage(spark, three, SF_SMOKE)
    assert four.columns == docs.columns and four.select("doc_id").distinct().count() == three.count()
    five = P.packing_stage(spark, four, SF_SMOKE).collect()
    assert sum(p.length for p in five if p.start == 0) > 0 and zlib.crc32(b"") == 0
    assert len({p.doc_id for p in five}) == three.count()
