"""The strict parser and scalar rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelforge.functions import parse as PZ
from panelforge.functions import periods as PR


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,want", [
    ("346,192", 346192), ("200356", 200356), ("1,234,567", 1234567), (" 1276 ", 1276), ("0", 0),
])
def test_thousands_separator(spark, raw, want):
    assert one(spark, PZ.strict_int, raw) == want
    assert one(spark, PZ.parse_reason, raw) is None


@pytest.mark.parametrize("raw,reason", [
    ("", "blank"), (None, "blank"), ("   ", "blank"), ("-5", "not_digits"), ("1.5", "not_digits"),
    ("12a", "not_digits"), ("1_000", "not_digits"), ("１２３", "not_digits"),
    ("12345678901234567890", "overflow"), ("9223372036854775808", "overflow"),
])
def test_rejected_cells_have_a_reason(spark, raw, reason):
    assert one(spark, PZ.parse_reason, raw) == reason
    assert one(spark, PZ.strict_int, raw) is None


def test_bigint_edge_and_unicode_space(spark):
    assert one(spark, PZ.strict_int, "9223372036854775807") == 9223372036854775807
    assert one(spark, PZ.strict_int, "00042") == 42
    assert one(spark, PZ.strict_int, "　 7,000 ") == 7000   # T3b: Unicode whitespace trimmed


def test_pct_diff_zero_rule(spark):
    df = spark.createDataFrame([(0, 0), (0, 3), (100, 95), (200, 210)], "a long, b long")
    got = [r[0] for r in df.select(PZ.pct_diff(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and got[1] == float("inf") and got[2] == 5.0 and got[3] == 5.0


def test_subtotal_classes(spark):
    df = spark.createDataFrame([(1000, 1000), (100000, 99950), (100000, 99000), (0, 5), (None, 3)],
                               "t long, p long")
    got = [r[0] for r in df.select(PZ.subtotal_class(F.col("t"), F.col("p"), 0.001)).collect()]
    assert got == ["exact", "within_tolerance", "mismatch", "mismatch", "unparsed"]


def test_roc_period_and_month_math(spark):
    df = spark.createDataFrame([("108/1",), ("115/4",), ("109/13",), ("bad",)], "p string")
    y, m = PR.roc_split(F.col("p"))
    out = df.select(PR.roc_to_ad(y).alias("y"), m.alias("m"),
                    PR.ym_text(PR.make_month(PR.roc_to_ad(y), m)).alias("ym")).collect()
    assert [(r.y, r.m, r.ym) for r in out] == [(2019, 1, "2019-01"), (2026, 4, "2026-04"), (2020, 13, None),
                                               (None, None, None)]
    d = spark.createDataFrame([("2019-12", "2020-01"), ("2019-01", "2026-04")], "a string, b string")
    r = d.select(PR.next_month(PR.parse_ym(F.col("a"))).alias("n"),
                 PR.span_months(PR.parse_ym(F.col("a")), PR.parse_ym(F.col("b"))).alias("s"),
                 PR.years_between(PR.parse_ym(F.col("a")), PR.parse_ym(F.col("b"))).alias("yrs")).collect()
    assert str(r[0].n) == "2020-01-01" and r[0].s == 2
    assert r[1].s == 88 and r[1].yrs == 7


def test_sql_text_rules_equal_column_rules(spark):
    cases = ["346,192", " 1276 ", "0", "", None, "   ", "-5", "1.5", "12a", "1_000", "１２３",
             "12345678901234567890", "9223372036854775808", "9223372036854775807", "00042", "　 7,000 "]
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    a = df.select(PZ.strict_int(F.col("x")).alias("v"), PZ.parse_reason(F.col("x")).alias("r"),
                  PZ.has_comma(F.col("x")).alias("c")).collect()
    c = PZ.sql_cleaned("x")
    b = df.selectExpr(f"{PZ.sql_strict_int(c)} AS v", f"{PZ.sql_parse_reason('x', c)} AS r",
                      f"{PZ.sql_has_comma('x')} AS c").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    t = spark.createDataFrame([(1000, 1000), (100000, 99950), (100000, 99000), (0, 5), (None, 3)], "t long, p long")
    x = [r[0] for r in t.select(PZ.subtotal_class(F.col("t"), F.col("p"), 0.001)).collect()]
    y = [r[0] for r in t.selectExpr(PZ.sql_subtotal_class("t", "p", 0.001)).collect()]
    assert x == y
