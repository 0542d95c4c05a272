"""Language ID by Bayesian evidence fusion.

Four kinds of evidence on a row's language are multiplied: the text's likelihood
under a trigram model of each language (and under a model of none, uniform over
trigram buckets), the declared markup language, the address's suffix, and a
prior from the row's host. How much a declaration or a suffix says, and the
priors, come from grouped sums of the text posteriors over all rows; priors are
smoothed from host to domain to all rows, each level by its parent's shares, and
leave the row itself out. A row is rejected if its text has no letters, if no
language beats the model of none, or if the best posterior is below
``least_posterior``.

The trigram model is fitted on a bounded sample of the rows with a declared
language (``sample`` rows a language, expected; whole texts); everything else
covers all rows. The model is languages x buckets in size; every language that a
handful of rows declare is in it, however large the corpus.

Rows: null and empty texts have no evidence and are rejected; a null declaration,
address or host says nothing; a declaration that is no language says what its rows' texts say; rows equal
in text, declaration, address and host get the same decision; other columns pass
through; an empty table, or one without declarations, gives languages none and
rejects all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, row_key, written

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
#: Trigrams overlap threefold, so each counts for a third.
TEMPER = 1 / 3
#: Weight of a parent's shares, in rows.
SMOOTHING = 20.0
#: ASCII that is no letter becomes a space.
FOLD = np.array([b if chr(b).isalpha() or b >= 128 else 32 for b in range(256)], dtype=np.uint8)
PIECE = 1 << 20


def _buckets(text: str) -> Iterator[np.ndarray]:
    """Hashed byte trigrams of the lower-cased letters, one space between words, a piece at a time."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), np.uint8)
    raw = FOLD[raw]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    for at in range(0, len(raw) - 2, PIECE):
        x = raw[at: at + PIECE + 2].astype(np.uint32)
        code = (x[:-2] << 16) | (x[1:-1] << 8) | x[2:]
        yield (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def _counts(text: str | None) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for part in _buckets(text or ""):
        out += np.bincount(part, minlength=BUCKETS)
    return out


def fit(rows: DataFrame, sample: int, least_rows: int = 5) -> tuple[list[str], np.ndarray]:
    """Languages and log trigram shares (languages, then none) from ``text, declared``.

    A language needs ``least_rows`` rows, however many rows others have. The model takes 64 KB a language: it is
    as large as the list of languages that are really declared. Rows are drawn by hash, at a rate that gives ``sample`` rows a language; the sums that reach the driver
    have one entry for each language and bucket at most.
    """
    known = rows.where("declared is not null and text is not null")
    sizes = known.groupBy("declared").agg(F.count(F.lit(1)).alias("n"))
    rates = {r.declared: min(1.0, sample / r.n) for r in sizes.where(F.col("n") >= least_rows).collect()}
    if not rates:
        return [], np.zeros((1, BUCKETS), dtype=np.float32)
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rate = F.get(F.array(*[F.lit(x) for x in rates.values()]), F.array_position(F.array(*[F.lit(x) for x in rates]), F.col("declared")).cast("int") - 1)
    drawn = known.where(F.col("declared").isin(*rates) & (hashed < rate)).select("declared", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + _counts(text)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    table = drawn.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    model = np.full((len(langs) + 1, BUCKETS), 0.05, dtype=np.float32)
    index = {x: i for i, x in enumerate(langs)}
    model[[index[x] for x in table["lang"].to_pylist()], table["bucket"].to_numpy().astype(int)] += table["n"].to_numpy()
    model[-1] = 1.0
    model /= model.sum(axis=1, keepdims=True, dtype=np.float64).astype(np.float32)
    return langs, np.log(model, out=model)


def text_scores(rows: DataFrame, langs: list[str], model: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` columns and ``score``: tempered log-likelihood per language and none; null without letters."""
    columns = np.ascontiguousarray(model.T)
    schema = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep) + "score array<double>"

    def score(text: str | None) -> list[float] | None:
        total, n = np.zeros(columns.shape[1]), 0
        for part in _buckets(text or ""):
            total += columns[part].sum(axis=0, dtype=np.float64)
            n += len(part)
        return (total * TEMPER).tolist() if n else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                scores = pa.array([score(t) for t in part.column(0).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], scores], names=[*keep, "score"])

    return rows.select("text", *keep).mapInArrow(run, schema)


def _softmax(logs: Column) -> Column:
    return bind(F.array_max(logs), lambda m: bind(F.transform(logs, lambda x: F.exp(x - m)), lambda e: bind(
        F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda s: F.transform(e, lambda x: x / s))))


def _sums(df: DataFrame, by: list[str], size: int) -> DataFrame:
    """Sums of the text posteriors by group, as an array ``sum`` and its total ``n``."""
    parts = [F.sum(F.get("p", F.lit(i))).alias(f"s{i}") for i in range(size)]
    return df.groupBy(*by).agg(*parts).select(*by, F.array(*[f"s{i}" for i in range(size)]).alias("sum")).withColumn(
        "n", F.aggregate("sum", F.lit(0.0), lambda a, b: a + b))


def _share(sums: Column, n: Column, parent: Column) -> Column:
    return F.transform(sums, lambda x, i: (x + SMOOTHING * F.get(parent, i)) / (n + SMOOTHING))


def identify(df: DataFrame, text: Column, declared: Column, address: Column | None = None, host: Column | None = None,
             domain: Column | None = None, sample: int = 1000, least_posterior: float = 0.5) -> DataFrame:
    """``row`` (the input's columns), ``lang``, ``posterior``, ``text_lang``, ``kept``: one row per input row.

    ``declared`` is the markup language, ``address`` the address's suffix (or any
    part of it that hints at a language), ``host`` and ``domain`` the groups whose
    priors are smoothed; all are expressions on ``df``.
    """
    none = F.lit(None).cast("string")
    evidence = [text.cast("string").alias("text"), declared.cast("string").alias("declared"),
                *[(none if c is None else c.cast("string")).alias(n) for c, n in ((address, "address"), (host, "host"), (domain, "domain"))]]
    base = df.select(*evidence)
    base = base.withColumn("domain", F.coalesce("domain", "host"))
    langs, model = fit(base, sample)
    keyed = base.select("*", *row_key("text", "declared", "address", "host", "domain"))
    rows = df.select(F.struct("*").alias("row"), *evidence)
    rows = rows.withColumn("domain", F.coalesce("domain", "host"))
    rows = rows.select("row", *row_key("text", "declared", "address", "host", "domain"))
    if not langs:
        return rows.select("row", none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), F.lit(False).alias("kept"))
    scored = written(text_scores(keyed, langs, model, "_k1", "_k2", "declared", "address", "host", "domain"), "language-scores")
    posts = _posteriors(scored, langs, least_posterior, ["declared"] + ["address"] * (address is not None))
    posts = posts.groupBy("_k1", "_k2").agg(*[F.first(c).alias(c) for c in ("lang", "posterior", "text_lang", "kept")])
    posts = written(posts, "language-decisions")
    return rows.join(posts, ["_k1", "_k2"], "left").select("row", "lang", "posterior", "text_lang", F.coalesce("kept", F.lit(False)).alias("kept"))


def _posteriors(scored: DataFrame, langs: list[str], least: float, kinds: list[str]) -> DataFrame:
    size = len(langs)
    names = F.array(*[F.lit(x) for x in langs])
    uniform = F.array(*[F.lit(1.0 / size)] * size) if size else F.array().cast("array<double>")
    lit_none = F.lit(size)
    scored = scored.withColumn("in_langs", F.slice("score", 1, size))
    scored = scored.withColumn("p", _softmax(F.col("in_langs")))
    world = _sums(scored.where("score is not null"), [], size).select(
        _share(F.transform("sum", lambda x: F.coalesce(x, F.lit(0.0))), F.coalesce("n", F.lit(0.0)), uniform).alias("w"))
    shares = F.array(*[F.lit(float(x)) for x in world.first()[0]])
    told = scored.where("score is not null")
    domains = _sums(told.where("domain is not null"), ["domain"], size).withColumn("up", _share(F.col("sum"), F.col("n"), shares))
    hosts = _sums(told.where("host is not null"), ["domain", "host"], size).withColumnsRenamed({"sum": "host_sum", "n": "host_n"})
    hosts = written(hosts.join(domains.select("domain", "up"), "domain"), "language-hosts")
    out = scored.join(hosts, ["domain", "host"], "left")
    # The row itself is left out of its host's sums.
    own = F.transform("host_sum", lambda x, i: (F.greatest(F.lit(0.0), x - F.get("p", i)) + SMOOTHING * F.get("up", i))
                      / (F.greatest(F.lit(0.0), F.col("host_n") - 1) + SMOOTHING))
    out = out.withColumn("prior", F.coalesce(own, shares))
    for kind in ("declared", "address"):
        if kind in kinds:
            out = out.join(_hints(told, kind, langs), kind, "left")
        else:
            out = out.withColumn(f"{kind}_hint", F.lit(None).cast("array<double>"))
    logs = F.transform("in_langs", lambda x, i: x + F.log(F.get("prior", i))
                       + F.coalesce(F.get("declared_hint", i), F.lit(0.0)) + F.coalesce(F.get("address_hint", i), F.lit(0.0)))
    # None: declared and addressed as the average row is, prior one row in a hundred.
    against = F.get("score", lit_none) + F.lit(math.log(0.01))
    out = out.withColumn("post", _softmax(F.concat(logs, F.array(against))))
    best = F.array_position("post", F.array_max("post")).cast("int")
    text_best = F.array_position("p", F.array_max("p")).cast("int")
    lang = F.when(F.col("score").isNotNull() & (best <= size), F.get(names, best - 1))
    posterior = F.coalesce(F.array_max("post"), F.lit(0.0))
    return out.select("_k1", "_k2", lang.alias("lang"), posterior.alias("posterior"), F.get(names, text_best - 1).alias("text_lang"),
                      (lang.isNotNull()).alias("found")).withColumn("kept", F.col("found") & (F.col("posterior") >= least))


def _hints(told: DataFrame, kind: str, langs: list[str]) -> DataFrame:
    """For each value of ``kind``: per language, the log of how much likelier the value is under it than on average."""
    size = len(langs)
    sums = _sums(told.where(F.col(kind).isNotNull()), [kind], size).select(kind, "sum", "n")
    total = _sums(told.where(F.col(kind).isNotNull()), [], size).first()
    by_lang = [float(x or 0.0) for x in (total[0] or [0.0] * size)]
    n = sum(by_lang)
    average = F.col("n") / F.lit(max(n, 1.0))
    hint = F.transform("sum", lambda x, i: F.log((x + SMOOTHING * average) / (F.get(F.array(*[F.lit(v) for v in by_lang]), i) + SMOOTHING) / average))
    return written(sums.select(kind, hint.alias(f"{kind}_hint")), f"language-{kind}")
