"""Plan shape of the registered queries: pushdown, pruning, broadcast, no Python UDFs."""

from __future__ import annotations

import pytest

from panelforge.plans.oracle import ORACLE
from panelforge.plans.queries import REGISTRY

from .conftest import SF_CHECK


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_rollup_pushes_filters_and_prunes_columns(spark):
    p = plan(REGISTRY["region_rollup"](spark, SF_CHECK))
    assert "PushedFilters: [IsNotNull(o_orderpriority), IsNotNull(o_orderdate), " \
           "EqualTo(o_orderpriority,1-URGENT)" in p
    import re
    schemas = re.findall(r"ReadSchema: struct<(o_[^>]*)>", p)
    assert len(schemas) == 1
    cols = {c.split(":")[0] for c in schemas[0].split(",")}
    assert cols == {"o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice"}   # o_orderkey etc. pruned


def test_group_dimension_is_broadcast(spark):
    p = plan(REGISTRY["camp_monthly"](spark, SF_CHECK))
    assert "BroadcastHashJoin" in p or "BroadcastExchange" in p


def test_region_metrics_window_is_partitioned(spark):
    p = plan(REGISTRY["panel_metrics_by_region"](spark, SF_CHECK))
    assert "SinglePartition" not in p and "hashpartitioning(r_name" in p


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_no_python_udf_nodes(spark, name):
    p = plan(REGISTRY[name](spark, SF_CHECK))
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"):
        assert node not in p, (name, node)


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(REGISTRY)


def test_evidence_ranking_limits_before_the_shuffle(spark):
    p = plan(REGISTRY["evidence_top_n"](spark, SF_CHECK))
    assert "WindowGroupLimit" in p and "Partial" in p


def test_blocked_cumsum_reuses_its_shuffle(spark):
    df = REGISTRY["cumulative_blocked"](spark, SF_CHECK)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def test_orphan_counts_read_each_table_once_for_each_role(spark):
    p = final_plan(REGISTRY["fk_orphans"](spark, SF_CHECK)).split("Initial Plan")[0]
    assert p.count("lineitem.parquet") == 1


def test_running_sum_has_no_window_over_all_blocks(spark):
    p = plan(REGISTRY["cumulative_blocked"](spark, SF_CHECK))
    assert p.count("SinglePartition") <= 2 and "hashpartitioning(__sup" in p


@pytest.mark.parametrize("name", ["overlap_stats", "overlap_stats_lines", "splice_verdict", "splice_verdict_lines"])
def test_overlap_reads_each_source_once_and_joins_nothing(spark, name):
    p = final_plan(REGISTRY[name](spark, SF_CHECK)).split("Initial Plan")[0]
    assert p.count("orders.parquet") == 2 and "NestedLoopJoin" not in p
    assert "SortMergeJoin" not in p or name.endswith("_lines")


@pytest.mark.parametrize("name", ["fk_orphans_sparse", "domain_violations_found", "overlap_stats_lines", "overlap_detail_by_nation"])
def test_real_differences_are_found(spark, name):
    """These queries exist because the clean relations, rules and sources hold no case."""
    rows = REGISTRY[name](spark, SF_CHECK).collect()
    if name == "overlap_stats_lines":
        assert all(r.max_pct > 0 and r.n_exact < r.n_pairs for r in rows)
    elif name == "overlap_detail_by_nation":
        assert {r.status for r in rows} == {"both", "missing_b", "missing_both"} and any(r.delta for r in rows)
    else:
        assert all(r[-1] > 0 for r in rows)
