"""Mixing sources to target weights: temperature mixing, with DataFrame functions only.

A source's weight is its token share to the power ``a``, normalised. The
exponent in [0, 1] is bisected (64 points a round, each round one grouped
aggregate over the source totals) until it meets a limit on repetition or a
target entropy. A source's epochs are its weight times the token budget over its
tokens. Without a budget, the budget is the least that gives every source one
epoch at least: no document is dropped, small sources repeat.

The weights are realised as budgeted permutations: within a source, documents
lie in blocks by a hash (a new permutation for each seed); whole epochs take
each document once, and a fractional epoch takes the permutation up to the
document that reaches the budget. Where that is comes from running sums, first
over super-blocks, then over the blocks of one super-block, then over the
documents of one block, so that no task sums over a whole source. The result is
one boundary for each source, and a document's number of copies is a comparison
with it: the documents are never sorted, and only the source table is joined.

Rows: a null source is a source of its own; null and empty texts have no
tokens; a source without tokens keeps one copy of each row; repeated rows share
a place in the permutation and are taken together; extra columns are passed
through in ``row``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_SPACE, row_key, written

POINTS = 64
ROUNDS = 6
#: Documents of a block, and blocks of a super-block, about.
BLOCK = 4096


def count_words(text: Column) -> Column:
    """Words of a text: white space and the word after it become one character each; what white space is left ends the text."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.length(F.rtrim(marks, F.lit(WORD_SPACE))).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))


def _grid(totals: DataFrame, low: float, high: float) -> list:
    """For each of POINTS + 1 exponents: the highest ratio of repetition to that of the least repeated
    source, and the entropy of the weights."""
    step = (high - low) / POINTS
    points = F.explode(F.sequence(F.lit(0), F.lit(POINTS))).alias("i")
    at = totals.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("x"), points)
    at = at.withColumn("a", F.lit(low) + F.col("i") * F.lit(step))
    rep = (F.col("a") - 1) * F.col("x")  # log of weight over tokens, but for a constant
    w = F.exp(F.col("a") * (F.col("x") - F.lit(20.0)))
    return at.groupBy("i", "a").agg(
        F.exp(F.max(rep) - F.min(rep)).alias("repeats"),
        (F.log(F.sum(w)) - F.sum(w * F.col("a") * (F.col("x") - F.lit(20.0))) / F.sum(w)).alias("entropy"),
    ).orderBy("i").collect()


def exponent(totals: DataFrame, max_repeats: float | None = None, target_entropy: float | None = None) -> float:
    """Least exponent whose most repeated source is repeated at most ``max_repeats`` times as often as the
    least repeated one; or the one whose weights have ``target_entropy`` (nats), clipped to [0, 1]."""
    if (max_repeats is None) == (target_entropy is None):
        raise ValueError("give max_repeats or target_entropy")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        rows = _grid(totals, low, high)
        if not rows:
            return 1.0
        good = [r for r in rows if (r.repeats <= max_repeats if max_repeats is not None else r.entropy <= target_entropy)]
        if not good:
            return rows[-1].a
        i = good[0].i
        if i == 0:
            return good[0].a
        low, high = rows[i - 1].a, rows[i].a
    return high


def _boundaries(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``plan`` with the place (super, block, hash) up to which the last, partial epoch goes."""
    part = docs.join(plan.where("part_tokens > 0").select("source_key", "supers", "blocks", "part_tokens"), "source_key")
    placed = part.select("source_key", "part_tokens", "tokens", *_place(seed))
    by_block = placed.groupBy("source_key", "part_tokens", "super", "block").agg(F.sum("tokens").alias("tokens"))
    by_super = by_block.groupBy("source_key", "part_tokens", "super").agg(F.sum("tokens").alias("tokens"))

    def holding(sums: DataFrame, group: list[str], order: str, base: Column) -> DataFrame:
        """The row of each group in which the running sum reaches the budget; ``base``: the sum before the group."""
        upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("upto", base + F.sum("tokens").over(upto)).withColumn("before", F.col("upto") - F.col("tokens"))
        return run.where("before < part_tokens and upto >= part_tokens")

    s = holding(by_super, ["source_key"], "super", F.lit(0)).select("source_key", "super", F.col("before").alias("base"))
    b = holding(by_block.join(s, ["source_key", "super"]), ["source_key", "super"], "block", F.col("base"))
    b = b.select("source_key", "super", "block", F.col("before").alias("base"))
    same = placed.join(b, ["source_key", "super", "block"]).groupBy(
        "source_key", "part_tokens", "super", "block", "base", "hash").agg(F.sum("tokens").alias("tokens"))
    d = holding(same, ["source_key", "super", "block"], "hash", F.col("base"))
    return plan.join(d.select("source_key", F.col("super").alias("at_super"), F.col("block").alias("at_block"),
                              F.col("hash").alias("at_hash")), "source_key", "left")


def _place(seed: int) -> list[Column]:
    spread = F.xxhash64(F.lit(seed), "_k1", "_k2")
    return [F.pmod(spread, "supers").alias("super"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "_k1", "_k2"), "blocks").alias("block"),
            F.xxhash64(F.lit(seed + 2), "_k1", "_k2").alias("hash")]


def mix(df: DataFrame, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id",
        max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: int | None = None,
        seed: int = 17, tokens: Column | None = None) -> DataFrame:
    """``row`` (the input's columns), ``tokens``, ``weight``, ``epochs``, ``copies``: one row per input row.

    ``tokens``: an expression on ``df``, by default the number of words.
    """
    count = (count_words(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")).alias("tokens")
    source = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"))
    light = written(df.select(source.alias("source_key"), count, *row_key(id_col, text_col)), "mixing-docs")
    totals = written(source_totals(light.withColumnRenamed("source_key", "source")).withColumnRenamed("source", "source_key"),
                     "mixing-sources")
    a = exponent(totals, max_repeats, target_entropy)
    top = totals.where("tokens > 0").agg(F.max("tokens"), F.sum("tokens")).first()
    most = float(top[0] or 1)
    share = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(most), F.lit(a))).otherwise(0.0)
    whole = totals.select(F.sum(share)).first()[0] or 1.0
    # The largest source is the least repeated one (a <= 1); at the least budget it has one epoch.
    amount = float(budget) if budget is not None else most * whole
    plan = totals.withColumn("weight", share / F.lit(whole))
    # A budget that meets a whole epoch but for the last digits is that epoch.
    epochs = F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(amount) / F.col("tokens"), 9)).otherwise(1.0)
    plan = plan.withColumn("epochs", epochs).withColumn("whole", F.floor("epochs"))
    plan = plan.withColumn("part_tokens", F.round((F.col("epochs") - F.col("whole")) * F.col("tokens")).cast("long"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("rows") / BLOCK))
    plan = plan.withColumn("supers", F.ceil(F.sqrt(blocks.cast("double"))).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(blocks / F.col("supers")).cast("long"))
    plan = written(_boundaries(light, plan, seed).drop("tokens", "rows"), "mixing-plan")
    rows = df.select(F.struct("*").alias("row"), source.alias("source_key"), count, *row_key(id_col, text_col))
    joined = rows.join(plan, "source_key")
    here, there = F.struct(*_place(seed)), F.struct("at_super", "at_block", "at_hash")
    taken = (F.col("part_tokens") > 0) & F.col("at_super").isNotNull() & (here <= there)
    copies = F.col("whole").cast("long") + taken.cast("long")
    return joined.select("row", "tokens", "weight", "epochs", copies.alias("copies"))
