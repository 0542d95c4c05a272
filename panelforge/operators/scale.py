"""R5, S9, G5, G13, G19, W4-at-scale: generator, rollup, sample statistics, blocked sums.

Everything here is built for rows counted in billions:

* ``blocked_cumsum`` — a running sum over a long ungrouped series without
  the single-partition window a global ``ORDER BY`` would need: in-block
  running sums (window per block), block totals (partial aggregate), block
  offsets (windows over the blocks of a super-block and over the super-blocks),
  joined back on the block key. The
  big side is already hash-partitioned by block from its window, so only the
  small offsets table moves (and AQE broadcasts it when its measured size
  allows).
* ``scale_table`` — deterministic expansion over ``spark.range`` (well
  partitioned, no cross join): each id is decoded into period, code, region
  and operator indices; periods and codes are tiny indexed dims joined back.
* ``exact_median`` — exact (interpolated) median per group in two passes of
  partial aggregates: a ``percentile_approx`` bracket around the middle
  ranks, then a count below it and a small histogram inside it. No task ever
  holds a whole group, however hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..spec import SCALE_MOD
from .joins import bounded_broadcast

#: Blocks of a super-block in :func:`blocked_cumsum`.
SUPER = 1 << 12


def blocked_cumsum(df: DataFrame, order_col: str, value_col: str, out: str,
                   block_size: int = 1 << 20, dims=()) -> DataFrame:
    """``SUM(value) OVER (PARTITION BY dims ORDER BY order_col)`` for a unique numeric key.

    NULL semantics match the plain window: NULL until the first non-NULL value.
    """
    blk = F.floor(F.col(order_col) / F.lit(block_size)).cast("bigint")
    d = df.withColumn("__blk", blk)
    w_in = Window.partitionBy(*dims, "__blk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    inner = d.withColumn("__in", F.sum(value_col).over(w_in))
    # a block's total is its last running sum (NULL only if all its values are),
    # read from the windowed side: that side is already hash-partitioned by
    # block, so the aggregate needs no exchange and the scan + shuffle are reused
    totals = inner.groupBy(*dims, "__blk").agg(F.max_by("__in", order_col).alias("__t"))
    # offsets in two levels: blocks within a super-block, then the super-blocks (N / block / SUPER rows at most)
    totals = totals.withColumn("__sup", F.floor(F.col("__blk") / SUPER).cast("bigint"))
    w_blk = Window.partitionBy(*dims, "__sup").orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    w_sup = Window.partitionBy(*dims).orderBy("__sup").rowsBetween(Window.unboundedPreceding, -1)
    supers = totals.groupBy(*dims, "__sup").agg(F.sum("__t").alias("__t")).select(
        *dims, "__sup", F.sum("__t").over(w_sup).alias("__o2"))
    near = totals.select(*dims, "__sup", "__blk", F.sum("__t").over(w_blk).alias("__o1"))
    offsets = near.join(supers, [*dims, "__sup"]).select(*dims, "__blk", F.when(
        F.col("__o1").isNotNull() | F.col("__o2").isNotNull(),
        F.coalesce("__o1", F.lit(0)) + F.coalesce("__o2", F.lit(0))).alias("__off"))
    j = inner.join(offsets, [*dims, "__blk"], "left")
    res = F.when(F.col("__in").isNull() & F.col("__off").isNull(), F.lit(None)).otherwise(
        F.coalesce(F.col("__in"), F.lit(0)) + F.coalesce(F.col("__off"), F.lit(0)))
    return j.withColumn(out, res.cast(df.schema[value_col].dataType)).drop("__blk", "__in", "__off")


def indexed(df: DataFrame, col: str, idx: str) -> DataFrame:
    """Dense 0-based index over the distinct values of a small dimension column."""
    d = df.select(col).distinct()
    return d.withColumn(idx, (F.row_number().over(Window.orderBy(col)) - 1).cast("bigint"))


def scale_table(spark: SparkSession, periods: DataFrame, codes: DataFrame, n_regions: int,
                n_operators: int, n_periods: int, n_codes: int, partitions: int | None = None) -> DataFrame:
    """``n_periods × n_codes × n_regions × n_operators`` rows.

    ``accounts = (epoch_days*7 + r*131 + o*17 + length(code)*991) % 500000``;
    ``region_code = 'R' || lpad(r, 2, '0')``. ``periods`` (``year_month``) and
    ``codes`` (``tech_code``) are small dims indexed densely and broadcast
    (their sizes are the given counts, checked by the caller).
    """
    total = n_periods * n_codes * n_regions * n_operators
    ids = spark.range(0, total, numPartitions=partitions) if partitions else spark.range(0, total)
    o = (F.col("id") % n_operators) + 1
    r = (F.floor(F.col("id") / n_operators) % n_regions) + 1
    ci = F.floor(F.col("id") / (n_operators * n_regions)) % n_codes
    pi = F.floor(F.col("id") / (n_operators * n_regions * n_codes))
    base = ids.select(pi.cast("bigint").alias("__pi"), ci.cast("bigint").alias("__ci"),
                      r.cast("int").alias("r"), o.cast("int").alias("operator_id"))
    p = indexed(periods, "year_month", "__pi")
    c = indexed(codes, "tech_code", "__ci")
    j = base.join(bounded_broadcast(p, n_periods), "__pi").join(bounded_broadcast(c, n_codes), "__ci")
    accounts = ((F.unix_date("year_month").cast("bigint") * 7 + F.col("r") * 131 + F.col("operator_id") * 17
                 + F.length("tech_code") * 991) % SCALE_MOD).cast("bigint")
    return j.select(
        "year_month", "tech_code",
        F.concat(F.lit("R"), F.lpad(F.col("r").cast("string"), 2, "0")).alias("region_code"),
        "operator_id", accounts.alias("accounts"),
    )


def rollup(df: DataFrame, group: str, value: str, total: str = "total", avg: str = "avg_accounts") -> DataFrame:
    """SUM and AVG rounded half-up to BIGINT per group, largest total first.

    The average is ``sum / count`` in exact decimals, then rounded (a plain
    cast would truncate).
    """
    g = df.groupBy(group).agg(
        F.sum(value).cast("bigint").alias(total),
        F.round(F.sum(value).cast("decimal(38,0)") / F.count(value), 0).cast("bigint").alias(avg),
    )
    return g.orderBy(F.col(total).desc(), group)


MEDIAN_ACCURACY = 10_000


def median_bracket(value: Column, accuracy: int = MEDIAN_ACCURACY) -> Column:
    """Pass-1 sketch of :func:`exact_median`: ``[lo, hi]`` around the middle ranks.

    ``percentile_approx`` has rank error at most ``n / accuracy``; the bracket
    is five times that wide on each side. Usable inside any aggregate.
    """
    margin = 5.0 / accuracy
    qs = F.array(F.lit(max(0.0, 0.5 - margin)), F.lit(min(1.0, 0.5 + margin)))
    return F.percentile_approx(value.cast("double"), qs, accuracy)


def median_in_bracket(values: DataFrame, bracket: DataFrame, keys, out: str = "median") -> DataFrame:
    """Pass 2 of :func:`exact_median`.

    ``values`` has ``keys`` + ``__v``; ``bracket`` has ``keys`` + ``__n`` (the
    count of non-NULL values), ``__lo``, ``__hi``; without keys it is one row,
    read as a scalar, and the result is one row. One histogram aggregate: a
    single flagged row carries the count below the bracket and sorts first;
    values above the bracket are dropped; the two middle ranks are read off. A
    bracket that does not hold both of them (a sketch beyond its error bound)
    raises an error instead of giving a wrong value.
    """
    keys = list(keys)
    if keys:
        j = values.join(bracket, keys, "inner")
    else:
        one = bracket.select(F.struct("__n", "__lo", "__hi")).scalar()
        j = values.select("__v", one.alias("__one")).select("__v", "__one.*")
    is_below = F.col("__v") < F.col("__lo")
    h = (j.where(F.col("__v") <= F.col("__hi"))
         .groupBy(*keys, is_below.alias("__b"), F.when(~is_below, F.col("__v")).alias("__x"))
         .agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n")))
    w = Window.partitionBy(*keys).orderBy(F.col("__b").desc(), F.col("__x").asc()).rowsBetween(
        Window.unboundedPreceding, 0)
    h = h.withColumn("__cum", F.sum("__c").over(w))
    k1 = F.floor((F.col("__n") + 1) / 2)
    k2 = F.floor(F.col("__n") / 2) + 1
    g = h.groupBy(*keys).agg(
        F.min(F.when(F.col("__cum") >= k1, F.col("__x"))).alias("__x1"),
        F.min(F.when(F.col("__cum") >= k2, F.col("__x"))).alias("__x2"),
        (F.coalesce(F.max(F.when(F.col("__b"), F.col("__cum"))), F.lit(0)) < F.min(k1)).alias("__above"),
        (F.max("__cum") >= F.max(k2)).alias("__within"),
    )
    middle = F.when(F.col("__above") & F.col("__within"), (F.col("__x1") + F.col("__x2")) / 2).otherwise(
        F.raise_error(F.lit("the median bracket does not hold the middle ranks")).cast("double"))
    if not keys:                            # NULL when there was no value at all
        middle = F.when(F.col("__above").isNotNull(), middle)
    return g.select(*keys, middle.alias(out))


def exact_median(df: DataFrame, groups, value: str, out: str = "median",
                 accuracy: int = MEDIAN_ACCURACY) -> DataFrame:
    """Exact interpolated median per group, without one task per group.

    Pass 1 (partial aggregates only): per group the count ``n`` and a
    ``percentile_approx`` bracket ``[lo, hi]`` around the middle ranks
    (:func:`median_bracket`). Pass 2 (:func:`median_in_bracket`): the count of
    values below ``lo`` (one flagged row) and a histogram ``(value, count)`` of
    the values inside the bracket, in one aggregate — at most about
    ``10 n / accuracy`` distinct values, and a hot repeated value is one row.
    The two middle ranks ``floor((n+1)/2)`` and ``floor(n/2)+1`` are read off
    that small histogram. Exact, including ties and infinities; NULLs are
    ignored. With no groups the result is one row (NULL for empty input).
    """
    keys = list(groups)
    v = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    pass1 = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"),
                                 median_bracket(F.col("__v"), accuracy).alias("__q"))
    bracket = pass1.select(*keys, "__n", F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"))
    return median_in_bracket(v, bracket, keys, out)


def sample_stats(df: DataFrame, groups, value: str) -> DataFrame:
    """N, exact median, min and max per group (median via the histogram)."""
    basic = df.groupBy(*groups).agg(F.count(value).alias("n"), F.min(value).alias("min"),
                                    F.max(value).alias("max"))
    return basic.join(exact_median(df, groups, value), list(groups), "left")


def ratio(a: Column, b: Column) -> Column:
    """A / b, NULL when b is 0 or NULL."""
    return a / F.nullif(b, F.lit(0))
