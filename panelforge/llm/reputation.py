"""URL filters: rules on hosts and paths, and empirical-Bayes reputation of hosts.

Hosts are judged by labelled outcomes of their pages (1: bad). A beta prior for
hosts comes from their registered domain, whose own comes from its public
suffix, whose own comes from all pages: at each level the posterior mean of the
parent is the prior mean, and the prior's strength is the beta-binomial moment
estimate over the groups of that level. A host is blocked if even the lower
bound of its posterior bad rate is over ``limit``.

Counts are grouped sums by host (summed before the shuffle, so that one host may
hold any share of the pages) and then sums of those; the largest table besides
the pages has a row for each host. Verdicts return to the pages by an equality
join on the host.

Rows: a null url, or one without ``://``, has an empty host and path, which no
rule fits and the reputation of the empty host judges (it is a host like any
other); pages without label count for nothing; contradicting labels of a page
each count; repeated rows repeat; an empty table gives an empty result; without
labels nothing is blocked but by rule.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): a rule fits its host and all subdomains if the url's path starts with its path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Suffixes of two labels; a parameter, to be replaced by the registries' own list.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.za", "com.mx", "com.ar")
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits."""
    name = verdict = F.lit(None).cast("string")
    for kind, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        name = F.when(fits, F.lit(where + start)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The last label, or the last two where these are a registry's suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, long_suffixes=LONG_SUFFIXES) -> Column:
    """The suffix and one label more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, by: list[str], mean: Column) -> Column:
    """Beta-binomial strength by moments: between-group variance against the binomial one, summed over the groups
    that share a parent; ``mean`` is the parent's rate. Used as an aggregate over ``n, bad``."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2))
    m, total, squares = F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") * F.col("n"))
    within = F.first(mean) * (1 - F.first(mean))
    size = total - squares / total
    rho = (spread - (m - 1) * within) / F.when(size > 0, size) / F.when(within > 0, within)
    strength = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(STRONGEST))
    return F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.coalesce(strength, F.lit(STRONGEST))))


def _level(parent: DataFrame, children: DataFrame, up: str) -> DataFrame:
    """Children with the prior that their parent gives: its posterior mean and the strength among its children."""
    known = children.where("n > 0").join(parent.select(up, F.col("rate").alias("up_rate")), up)
    strengths = known.groupBy(up).agg(_strength(known, [up], F.col("up_rate")).alias("strength"))
    prior = parent.select(up, F.col("rate").alias("prior")).join(strengths, up, "left").withColumn(
        "strength", F.coalesce("strength", F.lit(STRONGEST)))
    both = children.join(prior, up)
    return both.withColumn("rate", (F.col("bad") + F.col("prior") * F.col("strength")) / (F.col("n") + F.col("strength")))


def hosts(pages: DataFrame) -> DataFrame:
    """``host, domain, suffix, n, bad, prior, strength, rate`` from ``host, bad`` (null: no label) per page."""
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    by_host = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    by_host = by_host.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    by_host = written(by_host.withColumn("world", F.lit("")), "hosts")
    by_domain = by_host.groupBy("domain", "suffix", "world").agg(*sums)
    by_suffix = by_domain.groupBy("suffix", "world").agg(*sums)
    # All pages: a uniform prior of two.
    world = by_suffix.groupBy("world").agg(*sums).withColumn("rate", (F.col("bad") + 1) / (F.col("n") + 2))
    suffixes = _level(world, by_suffix, "world").select("suffix", "rate")
    domains = _level(suffixes, by_domain, "suffix").select("domain", "rate")
    return _level(domains, by_host, "domain").select("host", "domain", "suffix", "n", "bad", "prior", "strength", "rate")


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 5000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-12:
            break
    return front * value


def lower_bound(a: float, b: float, tail: float) -> float:
    """The rate that the posterior Beta(a, b) is below with chance ``tail``."""
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < tail else (low, mid)
    return low


def filter_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url",
                label_id: str = "doc_id", bad: Column | None = None, rules=tuple(RULES), limit: float = 0.5,
                tail: float = 0.05) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_rate, bound``: one row per input row.

    ``labels`` gives outcomes by page: ``label_id`` and ``bad`` (an expression on
    it, 1 or 0 or null; by default quality 0 or toxic 1).
    """
    if bad is None:
        bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(
            F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([lower_bound(x, y, tail) for x, y in zip(a, b, strict=True)], dtype=np.float64)

    seen = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    marks = labels.select(F.col(label_id).cast("long").alias("page_id"), bad.cast("long").alias("bad")).where("bad is not null")
    marked = seen.select("page_id", "host").join(
        marks.groupBy("page_id").agg(F.max("bad").alias("bad")), "page_id", "left").select("host", "bad")
    known = hosts(marked)
    post = [F.col("bad") + F.col("prior") * F.col("strength"), F.col("n") - F.col("bad") + (1 - F.col("prior")) * F.col("strength")]
    judged = written(known.select("host", F.col("rate").alias("bad_rate"), bound(*post).alias("bound")), "host-reputation")
    name, verdict = _rule(F.col("host"), F.col("path"), rules)
    joined = seen.join(judged, "host", "left")
    learnt = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"),
                         "bad_rate", "bound")
