"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes the documents that the stage before it kept, as a DataFrame
with the columns of ``documents``, and returns what it keeps in the same columns;
the last returns packed pieces. ``run`` applies them in order, each written to
the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import language_id, line_dedup, mixing, packing, simhash
from panelforge.llm.common import ready, written
from panelforge.llm.tokens import public_vocabulary

#: No SQL twin: the stages hash, fit and tokenize; tests/llm holds them against brute force.
ORACLE_SQL = None


def _columns(docs: DataFrame, text: str | None = None) -> list:
    """The columns of ``docs`` out of ``row``; ``text`` names a column that replaces the text."""
    return [F.col(text).alias(c) if text and c == "text" else F.col("row")[c].alias(c) for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those that no language explains go."""
    ready(spark)
    found = language_id.identify(docs, F.col("text"), F.col("lang"), host=F.col("source"))
    return found.where("kept").select(*_columns(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of repeated lines; the character count follows the text."""
    ready(spark)
    clean = line_dedup.dedup_lines(docs).select(*_columns(docs, "text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id."""
    ready(spark)
    return simhash.keep_one(docs, words=3, bits=3)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks: once at least, twice at most."""
    ready(spark)
    mixed = mixing.mix(docs, max_repeats=2.0)
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return mixed.where("copies > 0").select("row", copies).select(*_columns(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of 4096-token sequences with a checksum of their ids."""
    ready(spark)
    pieces = packing.pack(docs, public_vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_stage), ("line_dedup", line_stage), ("simhash", simhash_stage),
          ("mixing", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
