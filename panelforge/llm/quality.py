"""Quality rules with risk-controlled thresholds, with DataFrame functions only.

Each rule is a number per document, high for bad ones. On labelled holdout
documents, a cutoff of a rule in a stratum is safe if the chance of seeing as few
rejected good documents as were seen, were the true rate of rejection ``alpha``,
is at most ``delta`` over the number of tests (exact binomial tail, Bonferroni
over every stratum, rule and cutoff tried): with confidence 1 - delta, no chosen
cutoff rejects more than ``alpha`` of the good documents of its stratum. The
chosen cutoff is the lowest safe one; a rule without one rejects nothing there.
``alpha`` is shared out between the rules, so that their union keeps to it.

Rows: null text has no words and fails the base rules; a null stratum is a
stratum of its own; documents without a label have no say; labels are taken once
per document id (null if they contradict); repeated rows repeat; an empty table
gives an empty result; without labels only the base rules reject.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SPACE, bind, words_of, written

SYMBOLS = "#*$%&|<>"
#: Cutoffs tried for each rule: a document is rejected if its value is above.
CUTOFFS = {
    "symbol_share": [0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3],
    "repeat_share": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4],
    "dup_line_share": [0.05, 0.1, 0.2, 0.3, 0.5],
    "upper_share": [0.05, 0.1, 0.2, 0.3, 0.5, 0.7],
    "long_words": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}


def _repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more in the array."""
    def hashes(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - 3)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def repeated(h: Column) -> Column:
        """The hashes that occur more than once, sorted."""
        return bind(F.sort_array(h), lambda s: F.filter(s, lambda x, i: (i > 0) & (x == F.get(s, i - 1))))

    def covered(h: Column) -> Column:
        """Sorting (hash, position) pairs puts equal windows side by side; then sorted positions are covered in turn."""
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def spots(p: Column) -> Column:
            near = F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1)["h"] == x["h"]))
                            | ((k < F.size(p) - 1) & (F.get(p, k + 1)["h"] == x["h"])))
            return F.sort_array(F.transform(near, lambda x: x["i"]))

        def cover(s: Column) -> Column:
            steps = F.transform(s, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(s, k - 1))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)
        return bind(pairs, lambda p: bind(spots(p), cover))

    def count(h: Column) -> Column:
        return F.when(F.size(repeated(h)) == 0, F.lit(0)).otherwise(covered(h))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(bind(hashes(words), count)).cast("long")


def measures(text: Column) -> list[Column]:
    """Base counts of whole texts, all from the text alone."""
    full = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(full, "\n"), lambda x: F.translate(x, WORD_SPACE, "") != "")
    of_words = bind(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"),
                                                       _repeat_words(w).alias("n_repeat_words")))
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                              (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [
        of_words.alias("_w"), of_lines.alias("_l"),
        F.length(F.translate(full, WORD_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(full) - F.length(F.translate(full, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(full) - F.length(F.translate(full, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    ]


def _rules() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": per("n_symbols", "word_chars"), "repeat_share": per("n_repeat_words", "n_words"),
            "dup_line_share": per("n_dup_lines", "n_lines"), "upper_share": per("n_upper", "word_chars"),
            "long_words": per("word_chars", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed in logs from the exact terms."""
    first = n * F.log1p(F.lit(-p))
    odds = F.log(F.lit(p)) - F.log1p(F.lit(-p))
    start = F.struct(first.alias("t"), first.alias("s"))

    def add(state: Column, j: Column) -> Column:
        t = state["t"] + F.log(n - j + 1) - F.log(j.cast("double")) + odds
        high = F.greatest(state["s"], t)
        s = high + F.log(F.exp(state["s"] - high) + F.exp(t - high))
        return F.struct(t.alias("t"), s.alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), F.least(k, n))).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(steps, start, add, lambda state: state["s"]))


def thresholds(holdout: DataFrame, alpha: float, delta: float) -> DataFrame:
    """``stratum, rule, cutoff`` of the lowest safe cutoffs, from ``stratum, good`` and the rules' values.

    Counts per stratum, rule and cutoff are grouped sums; nothing else of the
    holdout leaves the aggregate.
    """
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("value"), F.lit(c).alias("cutoff"))
                                for r, cs in CUTOFFS.items() for c in cs])).alias("x")
    seen = holdout.where("good").select("stratum", rules).groupBy("stratum", "x.rule", "x.cutoff").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("x.value") > F.col("x.cutoff")).cast("long")).alias("k"))
    tests = max(1, seen.select("stratum").distinct().count()) * sum(map(len, CUTOFFS.values()))
    each = alpha / len(CUTOFFS)
    # A count above what alpha allows on average has a tail near a half at least; it needs no sum.
    tail = F.when(F.col("k") <= F.col("n") * each, binomial_tail(F.col("k"), F.col("n"), each)).otherwise(1.0)
    safe = seen.where(tail <= F.lit(delta / tests))
    return safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def filter_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   stratum_col: str = "lang", label_id: str = "doc_id", label_col: str = "quality",
                   alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed``, ``failed`` (rules), ``kept``.

    ``alpha`` is the share of good documents that the rules may reject in a
    stratum, all rules together; ``delta`` the chance that any cutoff breaks that.
    """
    stratum = F.struct(F.col(stratum_col).isNull().alias("none"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("name"))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), *measures(F.col(text_col)))
    docs = written(docs.select("doc_id", "stratum", "_w.*", "_l.*", "word_chars", "n_symbols", "n_upper"),
                   "quality")
    docs = docs.withColumns(_rules())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    docs = docs.withColumn("base_failed", base)
    marks = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(
        "doc_id is not null and label is not null").groupBy("doc_id").agg(
        F.min("label").alias("a"), F.max("label").alias("b")).where("a = b")
    holdout = docs.where("not base_failed").join(marks.where("a = 1").select("doc_id", F.lit(True).alias("good")), "doc_id")
    safe = thresholds(holdout, alpha, delta).groupBy("stratum").agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"max_{r}") for r in CUTOFFS])
    safe = written(safe, "quality-cutoffs")
    judged = docs.join(safe, "stratum", "left")
    failed = F.filter(F.array(*[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in CUTOFFS]), lambda x: x.isNotNull())
    judged = judged.withColumn("failed", failed)
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "failed", kept.alias("kept"))
