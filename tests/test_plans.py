"""Plan-shape guards for the scale design (checked on the physical plans)."""

import re

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"


def _plan(spark, name) -> str:
    df = queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["A4", "W4", "M1_region", "M13", "M16", "M17", "M4", "A16"])
def test_series_queries_scan_the_raw_table_once(spark, name):
    assert _plan(spark, name).count("orders.parquet") == 1


def test_orders_scan_is_pruned_and_filtered(spark):
    plan = _plan(spark, "A4")
    scan = [line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line][0]
    cols = {re.sub(r"#\d+L?$", "", c) for c in re.search(r"FileScan parquet \[([^\]]*)\]", scan).group(1).split(",")}
    assert cols == {"o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"}
    assert "PushedFilters: [IsNotNull(o_custkey)" in scan


def test_sampler_limits_before_the_shuffle(spark):
    plan = _plan(spark, "W12")
    assert plan.count("WindowGroupLimit") >= 2          # partial (map side) and final


def test_materialized_fact_prunes_partitions(spark):
    plan = _plan(spark, "S6")
    assert re.search(r"PartitionFilters: \[[^\]]*sale_year#\d+ = 1998", plan)


@pytest.mark.parametrize("name", ["Q4", "Q5", "B4_fanout", "Q6_ar_menu"])
def test_views_scan_the_raw_table_once(spark, name):
    assert _plan(spark, name).count("orders.parquet") == 1


@pytest.mark.parametrize("name", ["M11_region", "M12_region", "M3", "M13_ar", "M13_ets", "Q6_ar_menu"])
def test_series_models_run_no_python(spark, name):
    plan = _plan(spark, name)
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


@pytest.mark.parametrize("name", ["J7", "M15", "M15_ols", "Q7_trend", "Q7_ar", "B4_fanout"])
def test_no_cartesian_products(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["A4", "A9", "M8", "B4", "Q7_trend", "B4_fanout"])
def test_no_round_robin_shuffles(spark, name):
    assert "RoundRobin" not in _plan(spark, name)


def test_keyed_regression_is_a_partial_aggregate(spark):
    from homecast.operators import regress as R
    from homecast.plans.pipeline import Pipeline
    d = Pipeline(spark, SF).sold("viz").select("Region", "price", "sqft", "baths")
    plan = R._gram(d, "price", ["sqft", "baths"], ["Region"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_covar_pop" in plan


@pytest.mark.parametrize("name", ["E12", "E14_summary", "E16", "E17", "X2"])
def test_pages_are_dealt_out_and_read_once(spark, name):
    # The pages' rows go to a set number of tasks before the markup is made, and no tag is looked for twice.
    plan = _plan(spark, name)
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_NUM" in x]
    assert any("o_orderkey" in x for x in dealt)
    assert len(re.findall(r"regexp_extract_all\([^\n]{0,80}?<meta", plan)) <= 1
    assert plan.count("(?i)<(?:!--") == 1
