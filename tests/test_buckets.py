"""Loads in several buckets: no task holds more than a bucket's rows, and results stay those of the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from tidemark.operators import marts
from tidemark.plans import load, oracle, registry
from tidemark.sources import seeds, warehouse

ROWS = 300
BASE = ["accounts_at_risk", "cohort_retention", "mrr_monthly", "revenue_drilldown", "revenue_mix", "threshold_hits"]
CORRECTED = ["corrections_log", "fact_after_corrections", "mrr_after_corrections"]
NATURAL = ["constraint_violations", "fact_by_natural_id", "load_rerun_counts", "refresh_log_recent"]
RECOVERED = ["load_after_failure", "load_after_failure_log"]
QUARANTINE = ["line_rejects", "unparsed_revenue"]


@pytest.fixture(scope="module")
def small_buckets():
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(warehouse, "BUCKET_ROWS", ROWS, raising=False)
        patch.setattr(registry, "_roots", {})
        yield


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def fullest(wh, table):
    bucket = F.pmod(F.hash("customer_key"), F.lit(wh.layout()))
    return wh.read(table).groupBy(bucket).count().agg(F.max("count")).first()[0]


def matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = ", ".join(sorted(df.columns))
    want = duck.sql(f"SELECT {columns} FROM ({oracle.statements()[name]})").fetchall()
    got = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    return got and sorted(map(str, got)) == sorted(map(str, want))


def test_buckets_follow_rows():
    assert warehouse.bucket_count(1 << 30, 9 * warehouse.BUCKET_ROWS) == 9


@pytest.mark.parametrize("fill", [registry.loaded_warehouse, registry.corrected_warehouse, registry.natural_warehouse, registry.recovered_warehouse, registry.quarantine_warehouse])
def test_rows_of_a_bucket_are_bounded(spark, small_buckets, fill):
    wh = fill(spark, DATA)
    assert fullest(wh, warehouse.FACT) < 2 * ROWS < wh.read(warehouse.FACT).count()


@pytest.mark.parametrize("name", BASE + CORRECTED + NATURAL + RECOVERED + QUARANTINE)
def test_results_in_several_buckets(spark, duck, small_buckets, name):
    assert matches_sql(spark, duck, name)


def shuffled_bytes(df):
    """Bytes that the shuffles of a frame wrote before compression."""
    df.collect()
    found = 0

    def walk(node):
        nonlocal found
        name = node.getClass().getSimpleName()
        if name == "ShuffleExchangeExec":
            found += node.metrics().get("dataSize").get().value()
        if name == "AdaptiveSparkPlanExec":
            walk(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            walk(node.plan())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_bitmaps_are_built_where_they_stay(spark, small_buckets):
    """Moved are narrow rows, one a fact row, and not a bitmap of 4 KB for each task and cell."""
    wh = registry.loaded_warehouse(spark, DATA)
    fact = wh.read(warehouse.FACT)
    bits = marts.customer_bits(fact, wh.read(warehouse.CUSTOMERS), seeds.plans(spark))
    assert 0 < shuffled_bytes(bits) < 200 * fact.count()


@pytest.mark.parametrize("fill", [registry.natural_warehouse, registry.corrected_warehouse, registry.recovered_warehouse])
def test_a_batch_is_compared_once(spark, small_buckets, fill):
    """What differs from the stored rows is kept, and nothing else."""
    wh = fill(spark, DATA)
    state = wh.published()
    changed = spark.read.parquet(f"{wh.root}/scratch/changes-{state.loads[-1]}")
    loaded = wh.read(warehouse.LOG).filter(F.col("log_id") == state.loads[-1]).first()["rows_loaded"]
    assert 0 < changed.count() == loaded < wh.read(warehouse.FACT).count()


def test_splits_are_bounded(spark):
    """A split of well packed rows is grouped or sorted by one task."""
    with load.load_settings(spark, 6 << 30, 4):
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{32 << 20}b"
