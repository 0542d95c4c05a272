"""The training-data operators applied to the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table_path
from . import alignment, language_id, line_dedup, mixing, nn_descent, packing, pii, quality, reputation, runs, sharding, simhash, substring
from .common import ready, words_of
from .tokens import public_vocabulary

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(table_path(sf_dir, name))


@register
def op1_packing(spark, sf_dir):
    """Pieces of all documents in sequences of 4096 tokens."""
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register
def op2_language_id(spark, sf_dir):
    """Language of all documents: text, declared language, and the source as host."""
    docs = _table(spark, sf_dir, "documents")
    found = language_id.identify(docs, F.col("text"), F.col("lang"), host=F.col("source"))
    return found.select("row.doc_id", F.col("row.lang").alias("declared"), "lang", "posterior", "text_lang", "kept")


@register
def op2_language_id_pages(spark, sf_dir):
    """Language of all pages: text of the markup, its declared language, the address's suffix, host and domain."""
    pages = _table(spark, sf_dir, "pages")
    text = F.regexp_replace(F.col("html"), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    declared = F.nullif(F.lower(F.regexp_extract("html", r"""(?i)<html[^>]*\blang=["']?([a-z]+)""", 1)), F.lit(""))
    host = F.nullif(reputation.host_of(F.col("url")), F.lit(""))
    found = language_id.identify(pages, text, declared, address=reputation.suffix_of(host), host=host,
                                 domain=reputation.registered_domain(host))
    return found.select("row.page_id", "lang", "posterior", "text_lang", "kept")


@register
def op3_nn_descent(spark, sf_dir):
    """Links and components of all embeddings at cosine 0.9."""
    return nn_descent.near_vectors(_table(spark, sf_dir, "embeddings"))


@register
def op4_pii(spark, sf_dir):
    """Personal data in all documents."""
    found = pii.find_pii(_table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda x: x["kind"].isin(*pii.KINDS[:pii.BASE]))
    counts = [count(k) for k in pii.KINDS[:pii.BASE]]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


@register
def op5_line_dedup(spark, sf_dir):
    """All documents without the repeats of three-line windows."""
    clean = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return clean.select("row.doc_id", "n_lines", "n_removed", "text")


@register
def op6_simhash(spark, sf_dir):
    """Fingerprints and near-duplicate components of all documents."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op7_mixing(spark, sf_dir):
    """Copies of all documents under temperature weights with at most twofold repetition."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "row.source", F.col("tokens").alias("n_tokens"), "weight", "epochs", "copies")


@register
def op8_substring(spark, sf_dir):
    """Passages of fifty words or more that repeat, exactly or nearly, in all documents."""
    return substring.passages(_table(spark, sf_dir, "documents"))


@register
def op9_url_filter(spark, sf_dir):
    """Verdicts on all pages by rule and by host reputation."""
    judged = reputation.filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "bad_rate", "bound")


@register
def op10_quality(spark, sf_dir):
    """Base counts and verdicts on all documents by risk-controlled thresholds."""
    judged = quality.filter_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         F.array_join("failed", ",").alias("failed_rules"), "kept")


@register
def op11_cross_alignment(spark, sf_dir):
    """Alignment of all documents under two vocabularies, with the corpus-wide counts of its links."""
    found = alignment.align(_table(spark, sf_dir, "documents"), public_vocabulary("byte_bpe_50k.json"),
                            public_vocabulary("piece_bpe_32k.model"), hashed=True)
    return found.select("row.doc_id", *alignment.MEASURES, F.col("alignment").alias("groups_sha256"))


@register
def op12_sharding(spark, sf_dir):
    """All documents in 24 shards of nearly equal bytes; equal texts lie side by side."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    sharded = sharding.shard_rows(_table(spark, sf_dir, "documents"), 24, size, group="text", ident="doc_id")
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary")).alias("text_crc32")
    return sharded.select("row.doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot",
                          F.lit(None).cast("int").alias("grown_shard"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """The contract's ``doc_id, text``: one text in ten repeats its own words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words")
    split = docs.select("doc_id", "text", F.when(h % 10 == 0, words_of(F.col("text"))).alias("words"))
    at = split.where(n > 0).withColumn("a", F.pmod(g, n).cast("int"))
    at = at.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - F.col("a")) / F.col("p")).cast("int")
    repeat = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    words = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), repeat), F.lit(1), n)
    plain = split.where("words is null or size(words) = 0")
    return at.select("doc_id", F.array_join(words, " ").alias("text")).unionByName(plain.select("doc_id", "text"))


@register
def op13_periodic_runs(spark, sf_dir):
    """Periodic runs in all documents, and the texts without their repeats."""
    found = runs.periodic_runs(_made_periodic(_table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    measured = found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                            F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return measured.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                           F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


ORACLE: dict[str, str] = {}
