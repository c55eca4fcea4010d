"""What the physical plans promise: shuffles, pushdown, pruning, no Python."""

import re

import pytest

from conftest import DATA
from tidemark.operators import fact as facts
from tidemark.plans import load, registry
from tidemark.sources import seeds, staging, warehouse

QUERIES = registry.QUERIES


@pytest.fixture(scope="module")
def big_plans(spark):
    """Plans as they come out when nothing but fixed tables is small enough to broadcast."""
    registry.loaded_warehouse(spark, DATA)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")
    yield lambda name: QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _hashed_by(plan):
    return re.findall(r"hashpartitioning\((.*?), \d+\)", plan)


@pytest.mark.parametrize("name", ["mrr_monthly", "revenue_drilldown", "cohort_retention", "revenue_mix"])
def test_no_shuffle_by_customer(big_plans, name):
    plan = big_plans(name)
    assert "Bucketed: true" in plan
    assert not [keys for keys in _hashed_by(plan) if "customer" in keys]


def test_load_from_keyed_staging_does_not_shuffle(spark, big_plans):
    wh = registry.loaded_warehouse(spark, DATA)
    stg = wh.read(warehouse.STAGING)
    good = staging.classify(stg, seeds.plans(spark), wh.read(warehouse.CALENDAR))
    rows = facts.fact_rows(good, wh.read(warehouse.CUSTOMERS))
    with load.load_settings(spark, 0, wh.buckets):
        for df in (
            facts.new_customers(good, wh.read(warehouse.CUSTOMERS)),
            rows,
            *facts.against_stored(rows, wh.read(warehouse.FACT), "1995-01-01", "2001-08-01"),
        ):
            assert not _hashed_by(df._jdf.queryExecution().executedPlan().toString())


def test_customer_join_is_co_located(big_plans):
    plan = big_plans("revenue_drilldown")
    assert plan.count("Bucketed: true") == 2 and "SortMergeJoin" in plan


def test_only_high_risk_keys_travel(big_plans):
    keys = [k for k in _hashed_by(big_plans("health_signals")) if "customer_key" in k]
    assert keys and all("CASE WHEN" in k for k in keys)


def test_one_month_opens_its_files_only(spark, big_plans):
    """The months come from the pointer; the fact is read in one of its partitions."""
    assert re.search(r"PartitionFilters: \[[^\]]*date_key#\d+ = \d{4}-", big_plans("accounts_at_risk"))
    df = QUERIES["accounts_at_risk"](spark, DATA)
    df.collect()
    wh = registry.loaded_warehouse(spark, DATA)
    shown = load.observed_month(wh.published())
    files = [f for f in wh.read(warehouse.FACT).inputFiles() if f"date_key={shown}" in f]
    read = re.search(r"number of files read: (\d+)", metrics_of(df, "fact_subscriptions"))
    assert int(read.group(1)) == len(files) < len(wh.read(warehouse.FACT).inputFiles())


@pytest.mark.parametrize("name", ["rls_fact_region_totals", "rls_mrr_monthly", "mrr_latest_emea"])
def test_the_policy_prunes_partitions(spark, name):
    """The policy's rows select the partitions of regions when the query runs."""
    registry.loaded_warehouse(spark, DATA)
    df = QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"mart_cells.*PartitionFilters: \[[^\]]*dynamicpruningexpression", plan)
    df.collect()
    wh = registry.loaded_warehouse(spark, DATA)
    read = re.search(r"number of files read: (\d+)", metrics_of(df, "mart_cells"))
    files = wh.read(warehouse.CELLS).inputFiles()
    assert int(read.group(1)) == len([f for f in files if "region=EMEA" in f]) < len(files)


def metrics_of(df, table):
    """The metrics of a table's scan in a collected frame, as text."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "FileSourceScanExec" and table in node.toString():
            metric = node.metrics().get("numFiles").get()
            found.append(f"number of files read: {metric.value()}")
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return "\n".join(found)


@pytest.mark.parametrize("name", ["overview_kpis", "drilldown_kpis_all", "revenue_impact_top8", "cohort_heatmap"])
def test_dashboard_reads_no_fact(big_plans, name):
    plan = big_plans(name)
    assert "mart_" in plan and "fact_subscriptions" not in plan


def test_columns_are_pruned(big_plans):
    read = re.search(r"ReadSchema: struct<([^>]*)>", big_plans("mrr_monthly")).group(1)
    assert "usage_score" not in read and "region" not in read


def test_slicers_reach_the_scan(big_plans):
    """The region is a partition of the marts; what else is chosen is pushed to their files."""
    plan = big_plans("drilldown_kpis_emea_growth")
    assert re.search(r"PartitionFilters: \[[^\]]*region#\d+ = EMEA", plan) and "EqualTo(plan_name,Growth)" in plan


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"staging_from_csv"}))
def test_no_cross_join_and_no_python(big_plans, name):
    plan = big_plans(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert operator not in plan
