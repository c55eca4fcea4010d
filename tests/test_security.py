"""What restricted users see: the stored marts against the live ones, for every mart."""

import pytest

from conftest import DATA
from tidemark.plans import load, registry
from tidemark.plans.suite import StoredSuite, Suite
from tidemark.sources import warehouse

MARTS = ["mrr", "drill", "cohorts", "at_risk", "alerts", "mix", "health", "region_months", "region_totals", "threshold_alerts"]
POLICY = [("emea", "EMEA"), ("both", "EMEA"), ("both", "APAC"), ("lost", "Atlantis")]
USERS = {"emea": {"EMEA"}, "both": {"EMEA", "APAC"}, "lost": set(), "nobody": set()}


@pytest.fixture(scope="module")
def suites(spark):
    wh = registry.loaded_warehouse(spark, DATA).bound()
    policy = spark.createDataFrame(POLICY, "db_user string, region string")
    as_of = registry.date.fromisoformat(load.observed_month(wh.published()))

    def build(user):
        return [kind.over(wh, user=user, policy=policy, as_of=as_of) for kind in (Suite, StoredSuite)]

    return build


@pytest.mark.parametrize("user", sorted(USERS))
def test_stored_marts_show_what_the_user_may_see(suites, user):
    live, board = suites(user)
    for name in MARTS:
        want = getattr(live, name)
        got = getattr(board, name).select(*want.columns)
        rows = sorted(map(repr, want.collect()))
        assert sorted(map(repr, got.collect())) == rows, name
        assert bool(rows) == bool(USERS[user]), name
    regions = {r.region for r in board.drill.select("region").distinct().collect()}
    assert regions == USERS[user] & {r.region for r in live.fact.select("region").distinct().collect()}


def test_newest_month_is_the_users(spark, suites):
    """Without a stated month, latest-month marts are about the newest month that the user can see."""
    wh = registry.loaded_warehouse(spark, DATA).bound()
    newest = {r.region: r.m for r in wh.read(warehouse.FACT).groupBy("region").agg({"date_key": "max"}).toDF("region", "m").collect()}
    policy = spark.createDataFrame(POLICY, "db_user string, region string")
    for kind in (Suite, StoredSuite):
        suite = kind.over(wh, user="emea", policy=policy)
        months = {r.month for r in suite.drill_latest.select("month").distinct().collect()}
        assert months == {newest["EMEA"]}
        assert {r.last_active_month for r in suite.at_risk.collect()} <= months
