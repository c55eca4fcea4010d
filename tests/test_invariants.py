"""Relations between marts, and marts against a plain Python reading of random rows."""

import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import DATA, month
from tidemark.operators import marts
from tidemark.plans import registry
from tidemark.plans.suite import Suite


@pytest.fixture(scope="module")
def suite(spark):
    return Suite.over(registry.loaded_warehouse(spark, DATA))


def test_group_revenue_adds_up(suite):
    want = {r.month: r.mrr for r in suite.mrr.collect()}
    for mart in (suite.drill, suite.mix):
        got = {r.month: r.m for r in mart.groupBy("month").agg(F.sum("mrr").alias("m")).collect()}
        assert got == want
    regions = marts.region_months(suite.fact).groupBy("date_key").agg(F.sum("mrr").alias("m"))
    assert {r.date_key: r.m for r in regions.collect()} == want


def test_rates_are_consistent(suite):
    assert suite.mrr.filter(F.abs(F.col("retention_rate") + F.col("churn_rate") - 1) > 1e-12).count() == 0
    firsts = suite.cohorts.filter("retained_customers = cohort_size").select("cohort_month").distinct()
    assert firsts.count() == suite.cohorts.select("cohort_month").distinct().count()


def test_tiers_cover_all_accounts(suite):
    assert suite.at_risk.filter("risk_tier not in ('HIGH', 'MEDIUM', 'LOW')").count() == 0
    active = marts.newest(suite.fact, "date_key").filter("churn_flag = 0").count()
    assert suite.at_risk.count() == active


def _random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        # Account 1 holds about a third of the rows, with duplicate account-months.
        key = 1 if rng.random() < 0.34 else rng.randint(2, 40)
        rows.append(
            (
                key,
                f"2024-{rng.randint(1, 9):02d}",
                {
                    "monthly_revenue": Decimal(rng.randint(0, 50000)) / 100,
                    "churn_flag": int(rng.random() < 0.1),
                    "region": rng.choice(["EMEA", "APAC"]),
                    "segment": rng.choice(["SMB", "Enterprise"]),
                    "plan_key": rng.randint(1, 4),
                    "failed_payments": rng.choice([0, 0, 0, 2]),
                },
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_marts_match_plain_python(fact_of, suite_of, seed):
    rows = _random_rows(seed)
    suite = suite_of(fact_of(*rows))

    by_month = defaultdict(list)
    by_group = defaultdict(list)
    first = {}
    for key, at, v in rows:
        by_month[month(at)].append((key, v))
        by_group[(month(at), v["region"], v["segment"])].append((key, v))
        first[key] = min(first.get(key, month(at)), month(at))

    for r in suite.mrr.collect():
        group = by_month[r.month]
        assert r.mrr == sum(v["monthly_revenue"] for _, v in group)
        assert r.active_customers == len({k for k, _ in group})
        assert r.churn_rate == sum(v["churn_flag"] for _, v in group) / len(group)

    for r in suite.health.collect():
        group = by_group[(r.month, r.region, r.segment)]
        assert r.high_risk_count == len({k for k, v in group if v["failed_payments"] == 2})

    drill = suite.drill.groupBy("month", "region", "segment").agg(
        F.sum("mrr").alias("mrr"), F.sum("churned_customers").alias("churned")
    )
    for r in drill.collect():
        group = by_group[(r.month, r.region, r.segment)]
        assert (r.mrr, r.churned) == (
            sum(v["monthly_revenue"] for _, v in group),
            sum(v["churn_flag"] for _, v in group),
        )

    kept = defaultdict(set)
    for key, at, v in rows:
        if not v["churn_flag"]:
            kept[(first[key], (month(at).year - first[key].year) * 12 + month(at).month - first[key].month)].add(key)
    got = {(r.cohort_month, r.period_num): r.retained_customers for r in suite.cohorts.collect()}
    assert got == {k: len(v) for k, v in kept.items()}
    for r in suite.cohorts.collect():
        base = min(p for c, p in kept if c == r.cohort_month)
        assert r.cohort_size == len(kept[(r.cohort_month, base)])
