"""DuckDB twins of the registered queries (the correctness oracle).

Tables are the driver's pre-registered views. Every aggregate is cast to a
fixed type (DuckDB ``sum(bigint)`` is HUGEINT, ``/`` is DOUBLE) and rounded
before integer casts, so names, types and values line up with Spark.
"""

from __future__ import annotations

# shared CTE pieces -----------------------------------------------------------
PANEL = """p AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ym,
         o_orderpriority AS tech_code,
         CAST(COUNT(*) AS BIGINT) AS accounts,
         CAST(SUM(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT)) AS BIGINT) AS cents
  FROM orders GROUP BY 1, 2)"""

GROUPS = """g AS (
  SELECT * FROM (VALUES ('1-URGENT','1-URGENT','A'), ('2-HIGH','2-HIGH','A'), ('3-MEDIUM','3-MEDIUM','B'),
                        ('4-NOT SPECIFIED','4-NOT SPECIFIED','EXCLUDED'), ('5-LOW','5-LOW','EXCLUDED'))
         AS t(tech_code, tech_name, camp))"""

def levels(*dims: str) -> str:
    """Both groups' sums side by side: one row for each month that either of them has."""
    on = " AND ".join(f"x.{d} = y.{d}" for d in (*dims, "ym"))
    keys = ", ".join(f"COALESCE(x.{d}, y.{d}) AS {d}" for d in (*dims, "ym"))
    cols = ", ".join(f"p.{d}" for d in (*dims, "ym"))
    one = f"SELECT {cols}, SUM(p.accounts) AS v FROM p, g WHERE p.tech_code = g.tech_code AND g.camp = '%s' GROUP BY ALL"
    return f"""cm AS (
  SELECT {keys}, CAST(x.v AS BIGINT) AS a, CAST(y.v AS BIGINT) AS b
  FROM ({one % 'A'}) x FULL JOIN ({one % 'B'}) y ON {on})"""


def metrics_body(*dims: str) -> str:
    """Everything from months numbered by how many come before: joins on that number instead of windows."""
    same = "".join(f" AND e.{d} = c.{d}" for d in dims)
    prior = "".join(f" AND q.{d} = n.{d}" for d in dims)
    span = "".join(f" AND t.{d} = n.{d}" for d in dims)
    step = "".join(f" AND s.{d} = t.{d}" for d in dims)
    out = "".join(f"n.{d}, " for d in dims)
    mean = "(SELECT CAST(ROUND(AVG(t.%s), 1) AS DOUBLE) FROM num t WHERE n.k > 10 AND t.k BETWEEN n.k - 11 AND n.k" + span + ")"
    grown = ("(SELECT CAST(SUM(t.%s - s.%s) AS BIGINT) FROM num t JOIN num s ON s.k + 1 = t.k" + step
             + " WHERE t.k <= n.k" + span + ")")
    return f"""num AS (SELECT c.*, (SELECT COUNT(*) FROM cm e WHERE e.ym < c.ym{same}) AS k FROM cm c),
m AS (
  SELECT {out}strftime(n.ym, '%Y-%m') AS ym, n.a, n.b, n.a + n.b AS total,
         CAST(ROUND(n.a * 100.0 / NULLIF(n.a + n.b, 0), 4) AS DOUBLE) AS a_share,
         n.a - q.a AS a_net, n.b - q.b AS b_net,
         {mean % 'a'} AS a_ma12, {mean % 'b'} AS b_ma12,
         {grown % ('a', 'a')} AS a_cum_net, {grown % ('b', 'b')} AS b_cum_net
  FROM num n LEFT JOIN num q ON q.k + 1 = n.k{prior})"""


LEVELS, METRICS_BODY = levels(), metrics_body()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


METRICS = with_(PANEL, GROUPS, LEVELS, METRICS_BODY)

REGION_PANEL = """p AS (
  SELECT r.r_name, CAST(date_trunc('month', o.o_orderdate) AS DATE) AS ym,
         o.o_orderpriority AS tech_code, CAST(COUNT(*) AS BIGINT) AS accounts
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey
  GROUP BY 1, 2, 3)"""

ORACLE: dict[str, str] = {}

ORACLE["camp_monthly"] = with_(PANEL, GROUPS, LEVELS) + """
SELECT strftime(ym, '%Y-%m') AS ym, a, b, a + b AS total FROM cm"""

ORACLE["panel_metrics"] = METRICS + "SELECT * FROM m ORDER BY ym"

ORACLE["panel_metrics_by_region"] = with_(REGION_PANEL, GROUPS, levels("r_name"), metrics_body("r_name")) + "SELECT * FROM m"


# --- wide text sources, unpivot, parse, contracts ----------------------------

CODES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _q(name: str) -> str:
    return '"' + name + '"'


def _fmt(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE format('{{:,}}', {x}) END"


def _wide_cte(live: bool) -> str:
    """CTE ``wl`` (live) or ``wg`` (legacy): the all-text wide table plus ``ym``."""
    parts = CODES[:4] if live else CODES
    total = "subtotal" if live else "total"
    where = "ym >= DATE '1997-01-01'" if live else "ym <= DATE '1998-08-01'"
    vals = ",\n    ".join(
        f"CAST(SUM(cents) FILTER (WHERE tech_code = '{c}') AS BIGINT) AS v{i}" for i, c in enumerate(CODES))
    inlist = ", ".join(f"'{c}'" for c in parts)
    name = "wl" if live else "wg"
    if live:
        period = "CAST(year(ym) - 1911 AS VARCHAR) || '/' || CAST(month(ym) AS VARCHAR) AS period"
        order = ["period", *CODES[:4], total, CODES[4]]
    else:
        period = "CAST(year(ym) - 1911 AS VARCHAR) AS roc_year, CAST(month(ym) AS VARCHAR) AS month"
        order = ["roc_year", "month", *CODES, total]
    body = {c: f"{_fmt(f'v{i}')} AS {_q(c)}" for i, c in enumerate(CODES)}
    body[total] = f"{_fmt('vs')} AS {total}"
    cols = ", ".join(body[c] for c in order if c in body)
    return f"""{name}_v AS (
  SELECT ym, {vals},
    CAST(SUM(cents) FILTER (WHERE tech_code IN ({inlist})) AS BIGINT) AS vs
  FROM p WHERE {where} GROUP BY ym),
{name} AS (
  SELECT ym, {period}, {cols} FROM {name}_v)"""


def _clean(x: str) -> str:
    return f"regexp_replace(replace({x}, ',', ''), '^\\s+|\\s+$', '', 'g')"


def _val(x: str) -> str:
    c = _clean(x)
    return f"(CASE WHEN regexp_full_match({c}, '[0-9]+') THEN TRY_CAST({c} AS BIGINT) END)"


def _reason(x: str) -> str:
    c = _clean(x)
    return (f"(CASE WHEN {x} IS NULL OR {c} = '' THEN 'blank' "
            f"WHEN NOT regexp_full_match({c}, '[0-9]+') THEN 'not_digits' "
            f"WHEN TRY_CAST({c} AS BIGINT) IS NULL THEN 'overflow' END)")


ORACLE["unpivot_cells"] = with_(PANEL, _wide_cte(True), _wide_cte(False)) + ",\ncells AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT '{s}' AS source, ym, '{c}' AS tech_code, {_q(c)} AS raw FROM {w}"
    for s, w in (("live", "wl"), ("legacy", "wg")) for c in CODES) + """)
SELECT strftime(ym, '%Y-%m') AS ym, tech_code, raw, """ + _val("raw") + " AS accounts, " + _reason("raw") + \
    " AS reason, source FROM cells"

ORACLE["parse_thousands"] = with_(PANEL) + """, t AS (SELECT ym, tech_code, cents, format('{:,}', cents) AS text FROM p)
SELECT strftime(ym, '%Y-%m') AS ym, tech_code, text, """ + _val("text") + " AS value, " + _reason("text") + \
    " AS reason, contains(text, ',') AS has_comma, " + _val("text") + " = cents AS roundtrip_ok FROM t"

def _roc(source: str, table: str, period: str, sep: str) -> str:
    return f"""SELECT '{source}' AS source, {period} AS period,
       CAST(CAST(split_part({period}, '{sep}', 1) AS INTEGER) + 1911 AS INTEGER) AS year,
       CAST(split_part({period}, '{sep}', 2) AS INTEGER) AS month,
       CAST(split_part({period}, '{sep}', 1) AS INTEGER) AS roc_year,
       CAST(quarter(ym) AS INTEGER) AS quarter,
       strftime(ym, '%Y-%m') AS ym
FROM {table}"""


ORACLE["roc_period"] = with_(PANEL, _wide_cte(True), _wide_cte(False)) + "\n" + _roc("live", "wl", "period", "/") + (
    "\nUNION ALL\n") + _roc("legacy", "wg", "(roc_year || ' ' || month)", " ")


def _checks_sql(live: bool) -> str:
    name = "wl" if live else "wg"
    tag = "live" if live else "legacy"
    rows = 56 if live else 44
    first, last = ("1997-01-01", "2001-08-01") if live else ("1995-01-01", "1998-08-01")
    numeric = [*CODES, "subtotal"] if live else [*CODES, "total"]
    parts = CODES[:4] if live else CODES
    total = "subtotal" if live else "total"
    bad = " + ".join(f"CAST({_reason(_q(c))} IS NOT NULL AS INTEGER)" for c in numeric)
    comma = " OR ".join(f"coalesce(contains({_q(c)}, ','), false)" for c in numeric)
    t = _val(total)
    pp = " + ".join(_val(_q(c)) for c in parts)
    cls = (f"(CASE WHEN {t} IS NULL OR ({pp}) IS NULL THEN 'unparsed' WHEN {t} = ({pp}) THEN 'exact' "
           f"WHEN {t} <> 0 AND abs(CAST({t} AS DOUBLE) - ({pp})) / abs(CAST({t} AS DOUBLE)) <= 0.001 "
           f"THEN 'within_tolerance' ELSE 'mismatch' END)")
    return f"""{tag}_a AS (
  SELECT CAST(COUNT(*) AS BIGINT) AS n,
         CAST(coalesce(SUM({bad}), 0) AS BIGINT) AS bad_cells,
         CAST(count_if({comma}) AS BIGINT) AS comma_rows,
         CAST(0 AS BIGINT) AS bad_width,
         CAST(count_if(ym IS NULL) AS BIGINT) AS bad_period,
         CAST(count_if({cls} = 'exact') AS BIGINT) AS exact,
         CAST(count_if({cls} = 'within_tolerance') AS BIGINT) AS within,
         CAST(count_if({cls} IN ('mismatch', 'unparsed')) AS BIGINT) AS mismatch,
         CAST(COUNT(DISTINCT ym) AS BIGINT) AS n_months, MIN(ym) AS first, MAX(ym) AS last
  FROM {name}),
{tag}_b AS (
  SELECT *, coalesce(CAST(date_diff('month', first, last) + 1 AS BIGINT), 0) AS span,
         n - bad_period - n_months AS dup_extra,
         coalesce(first = DATE '{first}' AND last = DATE '{last}', false) AS range_ok
  FROM {tag}_a),
{tag}_c AS (
  SELECT '{tag}' AS source, 'row_count' AS "check", n = {rows} AS passed, n AS n_total,
         CASE WHEN n = {rows} THEN 0 ELSE abs(n - {rows}) END AS n_bad,
         'rows=' || CAST(n AS VARCHAR) || ' expected={rows}' AS detail FROM {tag}_b
  UNION ALL SELECT '{tag}', 'row_width', bad_width = 0, n, bad_width,
         'short_or_long_rows=' || CAST(bad_width AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'period_parse', bad_period = 0, n, bad_period,
         'unparsed_periods=' || CAST(bad_period AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'numerics_parse', bad_cells = 0, n * {len(numeric)}, bad_cells,
         'comma_rows=' || CAST(comma_rows AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'subtotal_arithmetic', mismatch = 0, n, mismatch,
         'exact=' || CAST(exact AS VARCHAR) || ';within_tolerance=' || CAST(within AS VARCHAR)
         || ';mismatch=' || CAST(mismatch AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'no_duplicate_months', dup_extra = 0, n, dup_extra,
         'distinct_months=' || CAST(n_months AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'no_missing_months', span = n_months, span, span - n_months,
         'span=' || CAST(span AS VARCHAR) || ';months=' || CAST(n_months AS VARCHAR) FROM {tag}_b
  UNION ALL SELECT '{tag}', 'period_range', range_ok, 1, CASE WHEN range_ok THEN 0 ELSE 1 END,
         coalesce(strftime(first, '%Y-%m'), 'NULL') || '~' || coalesce(strftime(last, '%Y-%m'), 'NULL')
  FROM {tag}_b)"""


ORACLE["contract_summary"] = with_(PANEL, _wide_cte(True), _wide_cte(False), _checks_sql(True),
                                   _checks_sql(False)) + """
SELECT source, "check", passed, CAST(n_total AS BIGINT) AS n_total, CAST(n_bad AS BIGINT) AS n_bad, detail
FROM live_c UNION ALL SELECT source, "check", passed, CAST(n_total AS BIGINT), CAST(n_bad AS BIGINT), detail FROM legacy_c"""


def _evidence_sql(live: bool) -> str:
    name = "wl" if live else "wg"
    tag = "live" if live else "legacy"
    numeric = [*CODES, "subtotal"] if live else [*CODES, "total"]
    parts = CODES[:4] if live else CODES
    total = "subtotal" if live else "total"
    t = _val(total)
    pp = " + ".join(_val(_q(c)) for c in parts)
    cls = (f"(CASE WHEN {t} IS NULL OR ({pp}) IS NULL THEN 'unparsed' WHEN {t} = ({pp}) THEN 'exact' "
           f"WHEN {t} <> 0 AND abs(CAST({t} AS DOUBLE) - ({pp})) / abs(CAST({t} AS DOUBLE)) <= 0.001 "
           f"THEN 'within_tolerance' ELSE 'mismatch' END)")
    ptxt = "strftime(ym, '%Y-%m')"
    cells = "\n    UNION ALL ".join(
        f"SELECT 'numerics_parse' AS \"check\", ym, {ptxt} || ' {c}: ' || coalesce({_q(c)}, 'NULL') || ' (' "
        f"|| coalesce({_reason(_q(c))}, '') || ')' AS evidence FROM {name} WHERE {_reason(_q(c))} IS NOT NULL"
        for c in numeric)
    sub = (f"SELECT CASE WHEN {cls} = 'within_tolerance' THEN 'subtotal_within_tolerance' ELSE 'subtotal_arithmetic' END, "
           f"ym, {ptxt} || ': ' || coalesce(CAST({t} AS VARCHAR), 'NULL') || ' vs ' || "
           f"coalesce(CAST(({pp}) AS VARCHAR), 'NULL') FROM {name} "
           f"WHERE {cls} IN ('mismatch', 'unparsed', 'within_tolerance')")
    dups = (f"SELECT 'no_duplicate_months', ym, strftime(ym, '%Y-%m') FROM {name} WHERE ym IS NOT NULL "
            f"GROUP BY ym HAVING COUNT(*) > 1")
    gaps = (f"SELECT 'no_missing_months', ym, strftime(ym, '%Y-%m') || ' -> ' || strftime(nx, '%Y-%m') FROM "
            f"(SELECT ym, LEAD(ym) OVER (ORDER BY ym) AS nx FROM (SELECT DISTINCT ym FROM {name} WHERE ym IS NOT NULL)) "
            f"WHERE nx IS NOT NULL AND nx <> ym + INTERVAL 1 MONTH")
    return f"""{tag}_e AS (
    {cells}
    UNION ALL {sub}
    UNION ALL {dups}
    UNION ALL {gaps}),
{tag}_r AS (
  SELECT '{tag}' AS source, "check",
         CAST(ROW_NUMBER() OVER (PARTITION BY "check" ORDER BY ym NULLS FIRST, evidence) AS INTEGER) AS rank,
         evidence FROM {tag}_e)"""


ORACLE["evidence_top_n"] = with_(PANEL, _wide_cte(True), _wide_cte(False), _evidence_sql(True),
                                 _evidence_sql(False)) + """
SELECT * FROM live_r WHERE rank <= 3 UNION ALL SELECT * FROM legacy_r WHERE rank <= 3"""


# --- keyed-table contracts ---------------------------------------------------

ORACLE["subtotal_classes"] = """
WITH parts AS (
  SELECT l_orderkey, SUM(CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2))
           * (1 + CAST(l_tax AS DECIMAL(4,2))) * (1 - CAST(l_discount AS DECIMAL(4,2))) * 100, 0) AS BIGINT)) AS parts
  FROM lineitem GROUP BY l_orderkey),
j AS (
  SELECT CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS t,
         CAST(coalesce(parts, 0) AS BIGINT) AS p
  FROM orders LEFT JOIN parts ON o_orderkey = l_orderkey)
SELECT CASE WHEN t IS NULL OR p IS NULL THEN 'unparsed' WHEN t = p THEN 'exact'
            WHEN t <> 0 AND abs(CAST(t - p AS DECIMAL(38,0))) / abs(CAST(t AS DECIMAL(38,0))) <= 0.001 THEN 'within_tolerance'
            ELSE 'mismatch' END AS class,
       CAST(COUNT(*) AS BIGINT) AS n_orders
FROM j GROUP BY 1"""

ORACLE["duplicate_keys"] = """
SELECT l_orderkey, l_linenumber, CAST(COUNT(*) AS BIGINT) AS n
FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1"""

ORACLE["missing_months"] = with_(PANEL) + """,
s AS (SELECT tech_code, ym, LEAD(ym) OVER (PARTITION BY tech_code ORDER BY ym) AS nx
      FROM (SELECT DISTINCT tech_code, ym FROM p))
SELECT tech_code, strftime(ym, '%Y-%m') AS ym, strftime(nx, '%Y-%m') AS next_ym,
       CAST(date_diff('month', ym, nx) - 1 AS INTEGER) AS n_missing
FROM s WHERE nx IS NOT NULL AND nx <> ym + INTERVAL 1 MONTH"""

_FK = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]
_FK_SPARSE = [("orders", "o_orderkey", "lineitem", "l_orderkey"), ("labels", "doc_id", "pages", "page_id")]


def _orphans(relations) -> str:
    return "\nUNION ALL\n".join(
        f"""SELECT '{c}.{ck}->{p}.{pk}' AS relation, CAST(COUNT(*) AS BIGINT) AS n_child,
       CAST(count_if(k.{pk} IS NULL) AS BIGINT) AS n_orphans
FROM {c} LEFT JOIN (SELECT DISTINCT {pk} FROM {p}) k ON {c}.{ck} = k.{pk}"""
        for c, ck, p, pk in relations)


ORACLE["fk_orphans"] = _orphans(_FK)
ORACLE["fk_orphans_sparse"] = _orphans(_FK_SPARSE)


def _rules(table: str, rules: list[tuple[str, str]]) -> str:
    aggs = ", ".join(f"CAST(count_if(coalesce({pred}, false)) AS BIGINT) AS r{i}" for i, (_, pred) in enumerate(rules))
    sel = "\nUNION ALL ".join(
        f"SELECT '{table}' AS \"table\", '{name}' AS rule, n AS n_total, r{i} AS n_bad FROM {table}_v"
        for i, (name, _) in enumerate(rules))
    return f"{table}_v AS (SELECT CAST(COUNT(*) AS BIGINT) AS n, {aggs} FROM {table})", sel


_li_cte, _li_sel = _rules("lineitem", [
    ("l_orderkey_not_null", "l_orderkey IS NULL"), ("l_linenumber_not_null", "l_linenumber IS NULL"),
    ("l_shipdate_not_null", "l_shipdate IS NULL"), ("l_quantity_ge_0", "l_quantity < 0"),
    ("l_extendedprice_ge_0", "l_extendedprice < 0"), ("l_discount_0_1", "NOT (l_discount BETWEEN 0 AND 1)"),
    ("l_tax_0_1", "NOT (l_tax BETWEEN 0 AND 1)"), ("l_linenumber_1_7", "NOT (l_linenumber BETWEEN 1 AND 7)")])
_o_cte, _o_sel = _rules("orders", [
    ("o_orderkey_not_null", "o_orderkey IS NULL"), ("o_orderdate_not_null", "o_orderdate IS NULL"),
    ("o_totalprice_ge_0", "o_totalprice < 0"), ("o_orderstatus_domain", "NOT (o_orderstatus IN ('F', 'O', 'P'))"),
    ("o_month_1_12", "NOT (month(o_orderdate) BETWEEN 1 AND 12)")])
ORACLE["domain_violations"] = with_(_li_cte, _o_cte) + _li_sel + "\nUNION ALL " + _o_sel

_li_cte, _li_sel = _rules("lineitem", [
    ("l_quantity_le_45", "l_quantity > 45"), ("l_extendedprice_ge_1000", "l_extendedprice < 1000"),
    ("l_linenumber_1_6", "NOT (l_linenumber BETWEEN 1 AND 6)")])
_o_cte, _o_sel = _rules("orders", [
    ("o_totalprice_ge_10000", "o_totalprice < 10000"), ("o_orderstatus_closed", "NOT (o_orderstatus IN ('F', 'O'))")])
ORACLE["domain_violations_found"] = with_(_li_cte, _o_cte) + _li_sel + "\nUNION ALL " + _o_sel

ORACLE["cell_completeness"] = with_(PANEL) + """
SELECT strftime(ym, '%Y-%m') AS ym, CAST(COUNT(DISTINCT tech_code) AS BIGINT) AS n_codes,
       COUNT(DISTINCT tech_code) = 5 AS complete
FROM p GROUP BY ym"""


# --- overlap, verdict, splice --------------------------------------------------

SOURCES = """la AS (SELECT ym, tech_code, accounts, 'live' AS source FROM p WHERE ym >= DATE '1997-01-01'),
lb AS (SELECT ym, tech_code, accounts, 'legacy' AS source FROM p WHERE ym <= DATE '1998-08-01')"""

SOURCES_PERTURBED = """la AS (SELECT ym, tech_code, accounts, 'live' AS source FROM p WHERE ym >= DATE '1997-01-01'),
lb AS (SELECT ym, tech_code, CAST(accounts + CAST(ceil(accounts * 0.06) AS BIGINT) AS BIGINT) AS accounts,
              'legacy' AS source FROM p WHERE ym <= DATE '1998-08-01')"""

DETAIL = """per AS (SELECT DISTINCT ym FROM la INTERSECT SELECT DISTINCT ym FROM lb),
ex AS (SELECT ym, c.tech_code FROM per, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) c(tech_code)),
sa AS (SELECT ym, tech_code, MAX(accounts) AS v_a, COUNT(*) AS n_a FROM la
       WHERE tech_code IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ym, tech_code),
sb AS (SELECT ym, tech_code, MAX(accounts) AS v_b, COUNT(*) AS n_b FROM lb
       WHERE tech_code IN ('1-URGENT', '2-HIGH', '3-MEDIUM') GROUP BY ym, tech_code),
d AS (
  SELECT ex.ym, ex.tech_code, v_a, v_b, v_a - v_b AS delta,
         CASE WHEN v_a IS NOT NULL AND v_b IS NOT NULL THEN
           CASE WHEN v_a <> 0 THEN abs(CAST(v_a AS DOUBLE) - v_b) / v_a * 100
                WHEN v_a = v_b THEN 0.0 ELSE CAST('inf' AS DOUBLE) END END AS pct,
         CASE WHEN v_a IS NULL AND v_b IS NULL THEN 'missing_both' WHEN v_a IS NULL THEN 'missing_a'
              WHEN v_b IS NULL THEN 'missing_b' ELSE 'both' END AS status,
         CAST(coalesce(n_a, 0) AS BIGINT) AS n_a, CAST(coalesce(n_b, 0) AS BIGINT) AS n_b
  FROM ex LEFT JOIN sa USING (ym, tech_code) LEFT JOIN sb USING (ym, tech_code))"""

VERDICT = """v AS (
  SELECT CAST(count_if(status = 'both') AS BIGINT) AS n_pairs,
         CAST(count_if(status <> 'both') AS BIGINT) AS n_missing,
         CAST(count_if(n_a > 1 OR n_b > 1) AS BIGINT) AS n_dup_keys,
         CAST(median(pct) AS DOUBLE) AS median_pct, MAX(pct) AS max_pct,
         CAST(count_if(status = 'both' AND delta = 0) AS BIGINT) AS n_exact
  FROM d)
SELECT n_pairs, n_missing, n_dup_keys, median_pct, max_pct, n_exact,
       CASE WHEN n_missing > 0 OR n_dup_keys > 0 THEN 'invalid' WHEN n_pairs = 0 THEN 'abandon'
            WHEN median_pct > 5.0 THEN 'abandon' ELSE 'accept' END AS verdict,
       CASE WHEN n_missing > 0 THEN 'missing_keys' WHEN n_dup_keys > 0 THEN 'duplicate_keys'
            WHEN n_pairs = 0 THEN 'no_overlap' WHEN median_pct > 5.0 THEN 'median_above_threshold'
            ELSE 'median_within_threshold' END AS reason,
       coalesce(max_pct = 0, false) AS identical_overlap
FROM v"""

ORACLE["overlap_periods"] = with_(PANEL, SOURCES) + """
SELECT strftime(ym, '%Y-%m') AS ym FROM (SELECT DISTINCT ym FROM la INTERSECT SELECT DISTINCT ym FROM lb)"""

ORACLE["overlap_detail"] = with_(PANEL, SOURCES, DETAIL) + """
SELECT strftime(ym, '%Y-%m') AS ym, tech_code, v_a, v_b, delta, pct, status, n_a, n_b FROM d"""

STATS = """
SELECT 'ALL' AS tech_code, CAST(COUNT(pct) AS BIGINT) AS n_pairs, CAST(median(pct) AS DOUBLE) AS median_pct,
       MAX(pct) AS max_pct, CAST(count_if(delta = 0) AS BIGINT) AS n_exact FROM d WHERE status = 'both'
UNION ALL
SELECT tech_code, CAST(COUNT(pct) AS BIGINT), CAST(median(pct) AS DOUBLE), MAX(pct), CAST(count_if(delta = 0) AS BIGINT)
FROM d WHERE status = 'both' GROUP BY tech_code"""

LINES = """pl AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS ym, o_orderpriority AS tech_code, CAST(COUNT(*) AS BIGINT) AS accounts
  FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1, 2),
la AS (SELECT ym, tech_code, accounts FROM p WHERE ym >= DATE '1997-01-01'),
lb AS (SELECT ym, tech_code, accounts FROM pl WHERE ym <= DATE '1998-08-01')"""

ORACLE["overlap_stats"] = with_(PANEL, SOURCES, DETAIL) + STATS
ORACLE["overlap_stats_lines"] = with_(PANEL, LINES, DETAIL) + STATS
ORACLE["splice_verdict_lines"] = with_(PANEL, LINES, DETAIL, VERDICT)

ORACLE["overlap_detail_by_nation"] = """WITH f AS (
  SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS ym, o_orderpriority AS code,
         o_orderkey IN (SELECT l_orderkey FROM lineitem) AS lined
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-09-01'),
m AS (SELECT n_name, ym FROM f GROUP BY ALL HAVING bool_or(lined)),
w AS (
  SELECT m.n_name, m.ym, c.code AS tech_code,
         CAST(nullif(COUNT(f.code), 0) AS BIGINT) AS v_a, CAST(nullif(COUNT(f.code) FILTER (f.lined), 0) AS BIGINT) AS v_b
  FROM m CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM')) c(code)
  LEFT JOIN f ON f.n_name = m.n_name AND f.ym = m.ym AND f.code = c.code
  GROUP BY ALL)
SELECT n_name, strftime(ym, '%Y-%m') AS ym, tech_code, v_a, v_b, v_a - v_b AS delta,
       abs(CAST(v_a AS DOUBLE) - v_b) / v_a * 100 AS pct,
       CASE WHEN v_b IS NOT NULL THEN 'both' WHEN v_a IS NOT NULL THEN 'missing_b' ELSE 'missing_both' END AS status,
       CAST(v_a IS NOT NULL AS BIGINT) AS n_a, CAST(v_b IS NOT NULL AS BIGINT) AS n_b
FROM w"""

ORACLE["splice_verdict"] = with_(PANEL, SOURCES, DETAIL, VERDICT)
ORACLE["splice_verdict_perturbed"] = with_(PANEL, SOURCES_PERTURBED, DETAIL, VERDICT)

SPLICED = """sp AS (SELECT * FROM lb WHERE ym < DATE '1997-01-01' UNION ALL SELECT * FROM la WHERE ym >= DATE '1997-01-01')"""

ORACLE["spliced_panel"] = with_(PANEL, SOURCES, SPLICED) + """
SELECT strftime(ym, '%Y-%m') AS ym, tech_code, accounts, source FROM sp ORDER BY ym, tech_code"""

ORACLE["splice_fallback"] = with_(PANEL, SOURCES) + """
SELECT strftime(ym, '%Y-%m') AS ym, tech_code, accounts, source FROM la"""

ORACLE["post_splice_shape"] = with_(PANEL, SOURCES, SPLICED) + """
SELECT strftime(MIN(ym), '%Y-%m') AS first_ym, strftime(MAX(ym), '%Y-%m') AS last_ym,
       CAST(COUNT(DISTINCT ym) AS BIGINT) AS n_months, CAST(COUNT(*) AS BIGINT) AS n_rows FROM sp"""

ORACLE["provenance_by_source"] = with_(PANEL, SOURCES, SPLICED) + """
SELECT source, CAST(COUNT(*) AS BIGINT) AS n_rows, strftime(MIN(ym), '%Y-%m') AS first_ym,
       strftime(MAX(ym), '%Y-%m') AS last_ym,
       CAST(count_if((ym >= DATE '1997-01-01' AND source <> 'live') OR (ym < DATE '1997-01-01' AND source <> 'legacy')) AS BIGINT) AS n_wrong_side
FROM sp GROUP BY source"""


# --- star schema, merge, fingerprints ------------------------------------------

def _rt(*cols: str) -> str:
    def field(c: str) -> str:
        return f"regexp_replace(CAST({c} AS VARCHAR), '([\\\\|\\n])', '\\\\\\1', 'g')"
    return " || '|' || ".join(f"coalesce({field(c)}, '\\N')" for c in cols)


ORACLE["upsert_result"] = with_(PANEL, SOURCES) + """
SELECT strftime(ym, '%Y-%m') AS year_month, tech_code, accounts, source FROM (
  SELECT * FROM lb WHERE NOT EXISTS (SELECT 1 FROM la WHERE la.ym = lb.ym AND la.tech_code = lb.tech_code)
  UNION ALL SELECT * FROM la)"""

ORACLE["upsert_ignore"] = with_(PANEL, SOURCES) + """
SELECT strftime(ym, '%Y-%m') AS year_month, CAST(year(ym) AS INTEGER) AS year, CAST(month(ym) AS INTEGER) AS month,
       CAST(year(ym) - 1911 AS INTEGER) AS roc_year, CAST(quarter(ym) AS INTEGER) AS quarter
FROM (SELECT DISTINCT ym FROM lb UNION SELECT DISTINCT ym FROM la)"""

ORACLE["state_snapshot"] = with_(PANEL, SOURCES, SPLICED) + f""",
e AS (SELECT ym AS year_month, tech_code, accounts, {_rt('ym', 'tech_code', 'accounts', 'source')} AS t FROM sp),
pm AS (SELECT year_month, COUNT(*) AS n, SUM(accounts) AS s, md5(string_agg(t, chr(10) ORDER BY tech_code)) AS h
       FROM e GROUP BY year_month)
SELECT CAST(SUM(n) AS BIGINT) AS n_rows, CAST(SUM(s) AS BIGINT) AS sum_accounts,
       strftime(MIN(year_month), '%Y-%m') AS min_ym, strftime(MAX(year_month), '%Y-%m') AS max_ym,
       (SELECT CAST(COUNT(DISTINCT tech_code) AS BIGINT) FROM sp) AS n_tech,
       md5(string_agg(h, chr(10) ORDER BY year_month)) AS md5
FROM pm"""

ORACLE["fingerprint_keyed"] = with_(PANEL, SOURCES, SPLICED) + f""",
e AS (SELECT ym AS year_month, tech_code, {_rt('ym', 'tech_code', 'accounts', 'source')} AS t FROM sp),
pm AS (SELECT year_month, COUNT(*) AS n, md5(string_agg(t, chr(10) ORDER BY year_month, tech_code)) AS h
       FROM e GROUP BY year_month)
SELECT CAST(COUNT(*) AS BIGINT) AS n_blocks, CAST(SUM(n) AS BIGINT) AS n_rows,
       md5(string_agg(h, chr(10) ORDER BY year_month)) AS fingerprint
FROM pm"""

_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
       *[f"CAST(floor({c} * 100 + 0.5) AS BIGINT)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
       "l_returnflag", "l_linestatus", "CAST(l_shipdate AS DATE) - DATE '1970-01-01'"]
ORACLE["fingerprint_unkeyed"] = f"""
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(SUM(CAST('0x' || substr(md5({_rt(*_LI)}), 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum
FROM lineitem"""

ORACLE["summary_by_camp"] = with_(PANEL, GROUPS, SOURCES, SPLICED) + """
SELECT camp, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT tech_code) AS BIGINT) AS n_tech,
       strftime(MIN(ym), '%Y-%m') AS first_ym, strftime(MAX(ym), '%Y-%m') AS last_ym
FROM sp JOIN g USING (tech_code) GROUP BY camp"""

ORACLE["latest_period_gate"] = with_(PANEL, SOURCES) + """
SELECT strftime(c, '%Y-%m') AS current_ym, strftime(s, '%Y-%m') AS staged_ym, coalesce(s > c, false) AS has_new_period
FROM (SELECT (SELECT MAX(ym) FROM lb) AS c, (SELECT MAX(ym) FROM la) AS s)"""


# --- headline, breaks, annotations, anchors -----------------------------------

ORACLE["share_change"] = METRICS + """
SELECT ym, a_share, ROUND(a_share - LAG(a_share) OVER (ORDER BY ym), 4) AS share_change_pp FROM m"""

SC = """sc AS (SELECT *, ROUND(a_share - LAG(a_share) OVER (ORDER BY ym), 4) AS share_change FROM m)"""

ORACLE["break_neighbourhood"] = METRICS + "," + SC + """,
f AS (SELECT *, ym IN ('1997-01', '2000-01') AS at_,
             coalesce(LEAD(ym IN ('1997-01', '2000-01')) OVER (ORDER BY ym), false) AS before_,
             coalesce(LAG(ym IN ('1997-01', '2000-01')) OVER (ORDER BY ym), false) AS after_ FROM sc)
SELECT ym, CASE WHEN at_ THEN 'break' WHEN before_ THEN 'before' WHEN after_ THEN 'after' END AS position,
       a_net, b_net, a_share, share_change
FROM f WHERE at_ OR before_ OR after_"""

HEAD = """h AS (
  SELECT MAX(ym) AS latest_ym, arg_max(a_share, ym) AS latest_share,
         MAX(CASE WHEN ym = '1997-01' THEN a_share END) AS anchor_share
  FROM m WHERE a_share IS NOT NULL)"""

ORACLE["break_impact"] = METRICS + "," + SC + "," + HEAD + """
SELECT ym, share_change AS jump_pp, ROUND(latest_share - anchor_share, 4) AS delta_pp,
       ROUND(abs(share_change / NULLIF(ROUND(latest_share - anchor_share, 4), 0.0)) * 100, 2) AS pct_of_delta,
       ROUND(ROUND(latest_share - anchor_share, 4) - share_change, 4) AS residual_pp
FROM sc, h WHERE ym IN ('1997-01', '2000-01')"""

ORACLE["headline_delta"] = METRICS + "," + HEAD + """
SELECT '1997-01' AS anchor_ym, latest_ym, anchor_share, latest_share,
       ROUND(latest_share - anchor_share, 4) AS delta_pp,
       CAST(round_even(CAST((CAST(substr(latest_ym, 1, 4) AS INTEGER) - 1997) * 12
            + CAST(substr(latest_ym, 6, 2) AS INTEGER) - 1 AS DECIMAL(10,0)) / 12, 0) AS INTEGER) AS years
FROM h"""

ORACLE["annotated_series"] = METRICS + """,
notes AS (SELECT * FROM (VALUES ('1996-05', '1996-05 event', 'event'), ('1999-03', '1999-03-18 event', 'event'),
                                ('1997-01', '1997-01', 'break'), ('2000-01', '2000-01', 'break')) t(ym, label, kind))
SELECT m.ym, a_share, label, kind FROM m LEFT JOIN notes USING (ym)"""

ORACLE["gap_series"] = METRICS + """
SELECT ym, a_share, ROUND(100.0 - a_share, 4) AS b_share, ROUND(a_share - ROUND(100.0 - a_share, 4), 4) AS gap_pp,
       ym = '1997-01' AS is_anchor,
       ROUND(least(MIN(a_share) OVER (), 100.0 - MAX(a_share) OVER ()) - 5, 4) AS range_lo,
       ROUND(greatest(MAX(a_share) OVER (), 100.0 - MIN(a_share) OVER ()) + 5, 4) AS range_hi
FROM m"""

ORACLE["anchor_check"] = METRICS + """,
e AS (SELECT strftime(o_orderdate, '%Y-%m') AS ym,
             CAST(count_if(o_orderpriority IN ('1-URGENT', '2-HIGH')) AS BIGINT) AS exp_a,
             CAST(count_if(o_orderpriority = '3-MEDIUM') AS BIGINT) AS exp_b
      FROM orders WHERE strftime(o_orderdate, '%Y-%m') IN ('1997-01', '2000-01') GROUP BY 1)
SELECT e.ym, m.a = exp_a AS a_ok, m.b = exp_b AS b_ok,
       abs(m.a_share - ROUND(exp_a * 100.0 / (exp_a + exp_b), 2)) < 0.005 AS share_ok,
       ROUND(m.a_share, 2) AS share_2dp, ROUND(exp_a * 100.0 / (exp_a + exp_b), 2) AS exp_share
FROM e LEFT JOIN m USING (ym)"""

ORACLE["chart_long"] = METRICS + """
SELECT ym, 'a' AS series, CAST(a AS DOUBLE) AS value FROM m
UNION ALL SELECT ym, 'b', CAST(b AS DOUBLE) FROM m
UNION ALL SELECT ym, 'a_net', CAST(a_net AS DOUBLE) FROM m
UNION ALL SELECT ym, 'b_net', CAST(b_net AS DOUBLE) FROM m"""

ORACLE["last_n_periods"] = METRICS + "SELECT ym, a, b, total FROM m ORDER BY ym DESC LIMIT 3"


# --- scale: blocked sums, generator, rollups, sample statistics, JSON ----------

ORACLE["cumulative_blocked"] = """
SELECT o_orderkey, CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS cents,
       CAST(SUM(CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT)) OVER (ORDER BY o_orderkey) AS BIGINT) AS cum_cents
FROM orders"""

ORACLE["region_rollup"] = """
SELECT r.r_name, CAST(SUM(c) AS BIGINT) AS total, CAST(ROUND(AVG(c)) AS BIGINT) AS avg_cents
FROM (SELECT o_custkey, CAST(ROUND(CAST(o_totalprice AS DECIMAL(18,2)) * 100, 0) AS BIGINT) AS c FROM orders
      WHERE o_orderpriority = '1-URGENT'
        AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-01') o
JOIN customer ON o.o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region r ON n_regionkey = r.r_regionkey
GROUP BY r.r_name ORDER BY total DESC, r.r_name"""

SCALE = """pe AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS year_month FROM orders),
co AS (SELECT DISTINCT o_orderpriority AS tech_code FROM orders),
st AS (
  SELECT year_month, tech_code, 'R' || lpad(CAST(r AS VARCHAR), 2, '0') AS region_code, o AS operator_id,
         CAST(((CAST(date_diff('day', DATE '1970-01-01', year_month) AS BIGINT)) * 7 + r * 131 + o * 17
               + length(tech_code) * 991) % 500000 AS BIGINT) AS accounts
  FROM pe, co, range(1, 23) t1(r), range(1, (SELECT COUNT(*) FROM supplier) + 1) t2(o))"""

ORACLE["scale_generate"] = with_(SCALE) + """
SELECT tech_code, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(accounts) AS BIGINT) AS sum_accounts,
       MIN(accounts) AS min_accounts, MAX(accounts) AS max_accounts,
       CAST(COUNT(DISTINCT region_code) AS BIGINT) AS n_regions
FROM st GROUP BY tech_code"""

ORACLE["scale_rollup"] = with_(SCALE) + """
SELECT region_code, CAST(SUM(accounts) AS BIGINT) AS total, CAST(ROUND(AVG(accounts)) AS BIGINT) AS avg_accounts
FROM st WHERE tech_code = '1-URGENT' AND year_month BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'
GROUP BY region_code ORDER BY total DESC, region_code"""

PHASED = """ev AS (SELECT event_type, value,
                   CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'before' ELSE 'after' END AS phase FROM events)"""

ORACLE["sample_stats"] = with_(PHASED) + """
SELECT event_type, phase, CAST(COUNT(value) AS BIGINT) AS n, MIN(value) AS min, MAX(value) AS max,
       CAST(median(value) AS DOUBLE) AS median
FROM ev GROUP BY event_type, phase"""

ORACLE["before_after_ratios"] = with_(PHASED) + """,
md AS (SELECT event_type, phase, CAST(median(value) AS DOUBLE) AS med FROM ev GROUP BY 1, 2),
g AS (SELECT event_type, MAX(CASE WHEN phase = 'before' THEN med END) AS median_before,
             MAX(CASE WHEN phase = 'after' THEN med END) AS median_after FROM md GROUP BY 1)
SELECT event_type, median_before, median_after,
       ROUND(median_before / NULLIF(median_after, 0), 4) AS ratio,
       ROUND((1.0 - median_before / NULLIF(median_after, 0)) * 100, 2) AS change_pct
FROM g"""

ORACLE["json_path"] = """
SELECT event_type, CAST(COUNT(*) AS BIGINT) AS n,
       CAST(COUNT(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS n_with_k,
       CAST(SUM(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k
FROM events GROUP BY event_type"""

ORACLE["source_invariants"] = with_(PANEL, SOURCES) + """,
inv AS (
  SELECT 'live' AS source, tech_code, MIN(ym) AS f, MAX(ym) AS l, COUNT(DISTINCT ym) AS n, DATE '1997-01-01' AS want
  FROM la GROUP BY tech_code
  UNION ALL
  SELECT 'legacy', tech_code, MIN(ym), MAX(ym), COUNT(DISTINCT ym), DATE '1995-01-01' FROM lb GROUP BY tech_code)
SELECT tech_code, strftime(f, '%Y-%m') AS first_ym, strftime(l, '%Y-%m') AS last_ym, CAST(n AS BIGINT) AS n_months,
       CAST(date_diff('month', f, l) + 1 AS INTEGER) AS span, f = want AS first_ok,
       n = date_diff('month', f, l) + 1 AS dense, source
FROM inv"""

ORACLE["missing_months_by_region"] = with_(REGION_PANEL) + """,
s AS (SELECT r_name, tech_code, ym, LEAD(ym) OVER (PARTITION BY r_name, tech_code ORDER BY ym) AS nx
      FROM (SELECT DISTINCT r_name, tech_code, ym FROM p))
SELECT r_name, tech_code, strftime(ym, '%Y-%m') AS ym, strftime(nx, '%Y-%m') AS next_ym,
       CAST(date_diff('month', ym, nx) - 1 AS INTEGER) AS n_missing
FROM s WHERE nx IS NOT NULL AND nx <> ym + INTERVAL 1 MONTH"""


# --- maintained state: the same from scratch ------------------------------------

NATION_STATE = """f AS (
  SELECT n_name, CAST(date_trunc('month', o_orderdate) AS DATE) AS ym, o_orderpriority AS tech_code,
         o_orderkey IN (SELECT l_orderkey FROM lineitem) AS lined
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
na AS (SELECT n_name, ym, tech_code, CAST(COUNT(*) AS BIGINT) AS accounts FROM f WHERE ym >= DATE '1997-01-01' GROUP BY ALL),
nb AS (SELECT n_name, ym, tech_code, CAST(COUNT(*) AS BIGINT) AS accounts FROM f
       WHERE lined AND ym <= DATE '1998-08-01' GROUP BY ALL),
p AS (SELECT * FROM na UNION ALL SELECT * FROM nb ANTI JOIN na USING (n_name, ym, tech_code))"""

ORACLE["rollup_incremental"] = with_(NATION_STATE) + """
SELECT n_name, CAST(year(ym) AS INTEGER) AS year, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(accounts) AS BIGINT) AS total,
       CAST(ROUND(AVG(accounts)) AS BIGINT) AS avg_accounts
FROM p GROUP BY 1, 2"""

# Windows here, not the self-joins of metrics_body: 25 nations would make those slow.
ORACLE["metrics_incremental"] = with_(NATION_STATE, GROUPS, levels("n_name")) + """,
n AS (SELECT *, a - LAG(a) OVER w AS a_net, b - LAG(b) OVER w AS b_net, ROW_NUMBER() OVER w AS k FROM cm
      WINDOW w AS (PARTITION BY n_name ORDER BY ym))
SELECT n_name, strftime(ym, '%Y-%m') AS ym, a, b, a + b AS total,
       CAST(ROUND(a * 100.0 / NULLIF(a + b, 0), 4) AS DOUBLE) AS a_share, a_net, b_net,
       CASE WHEN k >= 12 THEN CAST(ROUND(AVG(a) OVER t, 1) AS DOUBLE) END AS a_ma12,
       CASE WHEN k >= 12 THEN CAST(ROUND(AVG(b) OVER t, 1) AS DOUBLE) END AS b_ma12,
       CAST(SUM(a_net) OVER w AS BIGINT) AS a_cum_net, CAST(SUM(b_net) OVER w AS BIGINT) AS b_cum_net
FROM n WINDOW w AS (PARTITION BY n_name ORDER BY ym),
              t AS (PARTITION BY n_name ORDER BY ym ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""

ORACLE["warehouse_load"] = with_(PANEL, SOURCES, GROUPS) + """
SELECT strftime(s.ym, '%Y-%m') AS year_month, s.tech_code, s.accounts, s.source, g.camp,
       CAST(quarter(s.ym) AS INTEGER) AS quarter, CAST(year(s.ym) - 1911 AS INTEGER) AS roc_year
FROM (SELECT * FROM lb ANTI JOIN la USING (ym, tech_code) UNION ALL SELECT * FROM la) s JOIN g USING (tech_code)"""

ORACLE["state_diff_tree"] = """WITH a AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS quantity, l_returnflag, l_linestatus,
         CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS INTEGER) AS day FROM lineitem),
b AS (SELECT * REPLACE (quantity + CASE WHEN l_returnflag = 'R' AND day BETWEEN DATE '1997-05-01' - DATE '1970-01-01'
                                        AND DATE '1997-05-31' - DATE '1970-01-01' THEN 1 ELSE 0 END AS quantity)
      FROM a WHERE day < DATE '2001-10-01' - DATE '1970-01-01')
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, quantity, l_returnflag, l_linestatus, day,
       CAST(SUM(x) AS BIGINT) AS n_a, CAST(SUM(1 - x) AS BIGINT) AS n_b
FROM (SELECT *, 1 AS x FROM a UNION ALL SELECT *, 0 FROM b)
GROUP BY 1, 2, 3, 4, 5, 6, 7, 8 HAVING SUM(x) <> SUM(1 - x)"""
