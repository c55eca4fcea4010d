"""Hand-written rows with known results for the edges of each definition."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import month, only
from tidemark import functions as X
from tidemark import schemas as S
from tidemark.operators import alerting, audit, constraints, dashboard, marts, security
from tidemark.sources import seeds

D = Decimal


def test_zero_churn(fact_of):
    row = only(marts.mrr_monthly(fact_of((1, "2024-01", {}), (2, "2024-01", {}))))
    assert (row.ltv_proxy, row.churn_rate, row.retention_rate) == (None, 0.0, 1.0)


def test_first_month(fact_of):
    fact = fact_of((1, "2024-01", {}))
    assert only(marts.mrr_monthly(fact)).mrr_change is None
    assert marts.alerts(fact).count() == 0


def test_ltv_and_arr(fact_of):
    fact = fact_of(*[(k, "2024-01", {"churn_flag": int(k == 1)}) for k in range(1, 5)])
    row = only(marts.mrr_monthly(fact))
    assert (row.mrr, row.arr, row.arpu, row.churn_rate, row.ltv_proxy) == (400, 4800, 100.0, 0.25, 400.0)


def test_duplicate_account_month_counts_rows_and_customers_apart(fact_of):
    fact = fact_of((1, "2024-01", {"churn_flag": 1}), (1, "2024-01", {}), (2, "2024-01", {}))
    row = only(marts.mrr_monthly(fact))
    assert (row.active_customers, row.arpu) == (2, 150.0)
    assert row.churn_rate == pytest.approx(1 / 3)


def test_drilldown_with_duplicate_rows(fact_of, suite_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-01", {"churn_flag": 1}), (2, "2024-01", {}))
    row = only(suite_of(fact).drill)
    assert (row.mrr, row.active_customers, row.churned_customers) == (300, 2, 1)
    assert row.churn_rate == pytest.approx(1 / 3)
    assert row.arpu == 150.0


def test_cohort_all_churn_in_first_month(fact_of):
    fact = fact_of(
        (1, "2024-01", {"churn_flag": 1}),
        (2, "2024-01", {"churn_flag": 1}),
        (2, "2024-03", {}),
    )
    row = only(marts.cohort_retention(fact))
    assert (row.cohort_month, row.period_num, row.cohort_size) == (month("2024-01"), 2, 1)
    assert row.retention_rate == 1.0


def test_cohort_partial_first_month(fact_of):
    fact = fact_of(
        (1, "2024-01", {}), (2, "2024-01", {}), (3, "2024-01", {"churn_flag": 1}), (1, "2024-02", {})
    )
    rows = {r.period_num: r for r in marts.cohort_retention(fact).collect()}
    assert rows[0].cohort_size == rows[1].cohort_size == 2
    assert rows[1].retention_rate == 0.5


def test_region_gap_spans(fact_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-04", {"monthly_revenue": D("150.00")}))
    row = only(marts.alerts(fact))
    assert (row.prev_mrr, row.mrr_change_pct) == (100, 50.0)


def test_zero_previous_mrr(fact_of):
    fact = fact_of((1, "2024-01", {"monthly_revenue": D("0.00")}), (1, "2024-02", {}))
    row = only(marts.alerts(fact))
    assert row.mrr_change_pct is None and row.revenue_drop_flag is False


def test_zero_previous_churn(fact_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-02", {"churn_flag": 1}))
    row = only(marts.alerts(fact))
    assert row.churn_change_pct is None and row.churn_spike_flag is True


def test_flag_edges_are_strict(fact_of):
    before = [(k, "2024-01", {}) for k in range(25)]
    after = [
        (k, "2024-02", {"monthly_revenue": D("95.00"), "churn_flag": int(k < 2)}) for k in range(25)
    ]
    row = only(marts.alerts(fact_of(*before, *after)))
    assert (row.churn_rate, row.mrr_change_pct) == (0.08, -5.0)
    assert not row.churn_spike_flag and not row.revenue_drop_flag


def test_flag_limits_are_parameters(fact_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-02", {"monthly_revenue": D("97.00")}))
    assert not only(marts.alerts(fact)).revenue_drop_flag
    assert only(marts.alerts(fact, revenue_drop_share=-0.02)).revenue_drop_flag


def test_change_rounds_half_away_from_zero(fact_of):
    # 8 -> 8.001 is +0.0125 %, 8 -> 7.999 is -0.0125 %.
    up = fact_of(
        (1, "2024-01", {"monthly_revenue": D("8000.00")}), (1, "2024-02", {"monthly_revenue": D("8001.00")})
    )
    down = fact_of(
        (1, "2024-01", {"monthly_revenue": D("8000.00")}), (1, "2024-02", {"monthly_revenue": D("7999.00")})
    )
    exact = fact_of(
        (1, "2024-01", {"monthly_revenue": D("200.00")}), (1, "2024-02", {"monthly_revenue": D("199.99")})
    )
    assert only(marts.alerts(up)).mrr_change_pct == 0.01
    assert only(marts.alerts(down)).mrr_change_pct == -0.01
    assert only(marts.alerts(exact)).mrr_change_pct == -0.01


def test_tier_edges(spark):
    scores = ["39.99", "40.00", "69.99", "70.00"]
    df = spark.createDataFrame([(D(s),) for s in scores], "churn_risk_score decimal(5,2)")
    tiers = {str(r[0]): r[1] for r in df.select("churn_risk_score", X.risk_tier()).collect()}
    assert [tiers[s] for s in scores] == ["LOW", "MEDIUM", "MEDIUM", "HIGH"]


@pytest.mark.parametrize(
    "failed,tickets,usage,score",
    [
        (3, 9, "0.000", "100.00"),
        (1, 2, "0.500", "70.00"),
        (0, 0, "1.000", "0.00"),
        (0, 7, "1.000", "50.00"),
        (0, 0, "0.333", "26.68"),
    ],
)
def test_risk_score(spark, failed, tickets, usage, score):
    df = spark.createDataFrame(
        [(failed, tickets, D(usage))],
        "failed_payments int, support_tickets int, usage_score decimal(4,3)",
    )
    assert df.select(X.risk_score()).first()[0] == D(score)


def _spike_and_drop(fact_of):
    rows = [(k, "2024-01", {}) for k in range(4)]
    rows += [(k, "2024-02", {"churn_flag": int(k == 0), "monthly_revenue": D("50.00")}) for k in range(4)]
    return fact_of(*rows)


def test_both_alerts(fact_of, suite_of):
    suite = suite_of(_spike_and_drop(fact_of))
    active = {r.alert_type: r for r in suite.active_alerts.collect()}
    assert active["CHURN_SPIKE"].severity == "CRITICAL" and active["CHURN_SPIKE"].metric_value == 0.25
    assert active["REVENUE_DROP"].severity == "CRITICAL" and active["REVENUE_DROP"].metric_value == -50.0
    feed = only(alerting.alert_feed(suite.alerts))
    assert (feed.alert_type, feed.value, feed.month_label) == ("CHURN_SPIKE", 25.0, "Feb 24")


def test_disabled_threshold_gives_ok(spark, fact_of, suite_of):
    off = seeds.thresholds(spark).withColumn("enabled", F.col("metric_name") != "monthly_churn_rate")
    rows = suite_of(_spike_and_drop(fact_of), off).active_alerts.collect()
    assert {r.alert_type: r.severity for r in rows} == {"CHURN_SPIKE": "OK", "REVENUE_DROP": "CRITICAL"}


def test_active_alerts_only_newest_month(fact_of, suite_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-02", {"churn_flag": 1}), (1, "2024-03", {}))
    assert suite_of(fact).active_alerts.count() == 0


def test_drop_severity_differs_between_the_two_evaluators(spark, fact_of, suite_of):
    fact = fact_of((1, "2024-01", {}), (1, "2024-02", {"monthly_revenue": D("94.00")}))
    assert only(suite_of(fact).active_alerts).severity == "CRITICAL"
    judged = alerting.threshold_alerts(alerting.region_metrics(fact), seeds.thresholds(spark))
    drop = only(judged.filter("metric_name = 'mrr_drop_pct'"))
    assert (drop.metric_value, drop.severity) == (-0.06, "WARNING")


def test_threshold_evaluator_metrics(spark, fact_of):
    fact = fact_of((1, "2024-01", {"failed_payments": 1, "support_tickets": 5}), (2, "2024-01", {}))
    judged = alerting.threshold_alerts(alerting.region_metrics(fact), seeds.thresholds(spark))
    rows = {r.metric_name: (r.metric_value, r.severity) for r in judged.collect()}
    assert rows == {
        "monthly_churn_rate": (0.0, "OK"),
        "avg_risk_score": (60.0, "WARNING"),
        "failed_payment_rate": (0.5, "CRITICAL"),
    }


def test_top15_tie_takes_lowest_ids(fact_of, suite_of):
    fact = fact_of(*[(k, "2024-01", {}) for k in range(16, 0, -1)])
    ids = [r.customer_id for r in dashboard.top_risk_accounts(suite_of(fact).at_risk).collect()]
    assert ids == [f"CUST_{k:05d}" for k in range(1, 16)]


def test_at_risk_excludes_churned_and_older(fact_of, suite_of):
    fact = fact_of((1, "2024-01", {}), (2, "2024-02", {}), (3, "2024-02", {"churn_flag": 1}))
    assert only(suite_of(fact).at_risk).customer_id == "CUST_00002"


def test_empty_slicer(fact_of, suite_of):
    drill = suite_of(fact_of((1, "2024-01", {}))).drill
    row = only(dashboard.drilldown_kpis(drill, region="APAC", plan_name="All"))
    assert tuple(row) == (0, 0, 0.0, 0.0)
    with pytest.raises(ValueError):
        dashboard.slice_rows(drill, colour="red")


def test_customer_months_add_over_months(fact_of, suite_of):
    drill = suite_of(fact_of((1, "2024-01", {}), (1, "2024-02", {}))).drill
    assert only(dashboard.drilldown_kpis(drill)).customer_months == 2


def test_rls_sees_only_its_region(spark, fact_of):
    fact = fact_of((1, "2024-01", {}), (2, "2024-01", {"region": "APAC"}))
    policy = seeds.region_policy(spark)
    seen = security.visible_fact(fact, policy, "bi_analyst_emea")
    assert [r.region for r in seen.collect()] == ["EMEA"]
    assert security.visible_fact(fact, policy, "nobody").count() == 0
    assert security.visible_fact(fact, policy, None).count() == 2


def test_rls_after_limit(fact_of, suite_of):
    rows = [(k, "2024-01", {"region": "EMEA" if k <= 4 else "APAC"}) for k in range(1, 21)]
    top = dashboard.top_risk_accounts(suite_of(fact_of(*rows)).at_risk)
    assert security.analyst_top_risk(top, "EMEA").count() == 4


def test_region_mrr_without_rows(fact_of, suite_of):
    suite = suite_of(fact_of((1, "2024-01", {"region": "APAC"})))
    assert only(security.region_mrr(suite.mix_latest, "EMEA")).mrr == 0


def test_overview_with_one_month(fact_of, suite_of):
    suite = suite_of(fact_of((1, "2024-01", {"failed_payments": 2, "support_tickets": 3})))
    row = only(dashboard.overview_kpis(suite.mrr, suite.at_risk))
    assert row.high_risk_accounts == 1
    assert row.mrr_change_pct is None and row.retention_change_pp is None


def test_overview_changes(fact_of, suite_of):
    fact = fact_of(
        (1, "2024-01", {}),
        (2, "2024-01", {}),
        (1, "2024-02", {"monthly_revenue": D("250.00")}),
    )
    row = only(dashboard.overview_kpis(suite_of(fact).mrr, suite_of(fact).at_risk))
    assert (row.mrr_change_pct, row.customers_change_pct, row.retention_change_pp) == (25.0, -50.0, 0.0)


def test_risk_drivers_without_high_accounts(fact_of, suite_of):
    row = only(dashboard.risk_drivers(suite_of(fact_of((1, "2024-01", {}))).at_risk))
    assert tuple(row) == (0, 0, 0)


def test_risk_counts_keep_empty_tiers(fact_of, suite_of):
    rows = dashboard.risk_tier_counts(suite_of(fact_of((1, "2024-01", {}))).at_risk).collect()
    assert {r.risk_tier: r.accounts for r in rows} == {"HIGH": 0, "MEDIUM": 0, "LOW": 1}


@pytest.mark.parametrize("n,shown", [(5, [0, 1, 2, 3, 4]), (6, [0, 1, 2, 3, 4, 5]), (7, [0, 2, 4, 6])])
def test_heatmap_cohorts(spark, n, shown):
    months = [datetime.date(2024, 1 + i, 1) for i in range(n)]
    df = spark.createDataFrame([(m,) for m in months], "cohort_month date")
    got = sorted(r[0] for r in dashboard.shown_cohorts(df).collect())
    assert got == [months[i] for i in shown]


def test_heatmap_keeps_last_six(spark):
    months = [datetime.date(2023 + i // 12, 1 + i % 12, 1) for i in range(20)]
    df = spark.createDataFrame([(m,) for m in months], "cohort_month date")
    got = sorted(r[0] for r in dashboard.shown_cohorts(df).collect())
    assert got == months[0:20:2][-6:]


def test_feed_severity(spark):
    feed = spark.createDataFrame(
        [("CHURN_SPIKE", 8.0), ("CHURN_SPIKE", 10.4), ("CHURN_SPIKE", 7.9), ("REVENUE_DROP", -7.5),
         ("REVENUE_DROP", -5.0), ("REVENUE_DROP", -4.9)],
        "alert_type string, value double",
    ).withColumns({c: F.lit("x") for c in ["date_key", "month_label", "region", "label"]})
    got = [r.severity for r in alerting.feed_severity(feed).orderBy("alert_type", F.abs("value")).collect()]
    assert got == ["RESOLVED", "WARNING", "CRITICAL", "RESOLVED", "WARNING", "CRITICAL"]
    assert alerting.feed_severity(feed).first().title == "CHURN SPIKE"


def test_integer_rounding_goes_up_on_halves(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,)], "x double")
    assert [r[0] for r in df.select(X.half_up_int(F.col("x"))).collect()] == [3, -2, 2]


def test_month_label_and_distance(spark):
    df = spark.createDataFrame([(month("2024-12"), month("2023-11"))], "a date, b date")
    assert tuple(df.select(X.month_label("a"), X.months_between("a", "b")).first()) == ("Dec 24", 13)


def test_anon_id(spark):
    import hashlib

    want = "CUST_" + hashlib.sha256(b"cust_7").hexdigest()[:12].upper()
    assert spark.range(1).select(X.anon_id(F.lit("cust_7"))).first()[0] == want


def test_calendar(spark):
    rows = seeds.calendar(spark, "2023-01-01", "2025-12-01").orderBy("date_key").collect()
    assert len(rows) == 36
    first = rows[0]
    assert (first.month_name, first.week_num, first.day_of_week) == ("January", 52, 7)
    assert all(r.is_month_start and r.fiscal_year == r.year for r in rows)


def _log(spark, rows):
    full = [(i, ts, "scheduler", "fact_subscriptions", 8297, 0, st, err, 1) for i, (ts, st, err) in enumerate(rows)]
    return spark.createDataFrame(full, S.REFRESH_LOG)


def test_retention(spark):
    now = datetime.datetime(2024, 6, 1)
    log = _log(spark, [(now - datetime.timedelta(days=d), "SUCCESS", None) for d in (89, 90, 91)])
    kept = audit.retained(log, F.lit("2024-06-01").cast("timestamp"))
    assert sorted(r.log_id for r in kept.collect()) == [0, 1]


def test_recent_log_detail(spark):
    at = datetime.datetime(2024, 6, 1, 3)
    log = _log(spark, [(at, "SUCCESS", None), (at, "FAILED", "boom"), (at, "PARTIAL", None)])
    got = {r.status: r.detail for r in audit.recent(log).collect()}
    assert got == {"SUCCESS": "8,297 rows", "FAILED": "boom", "PARTIAL": "PARTIAL"}
    assert audit.recent(log, 2).count() == 2
    assert audit.recent(log).first().run_minute == "2024-06-01 03:00"


def test_constraints_find_what_breaks_them(spark, fact_of):
    fact = fact_of(
        (1, "2024-01", {}),
        (1, "2024-01", {"churn_flag": 2}),
        (2, "2024-01", {"region": None}),
        (3, "2024-01", {"usage_score": D("1.200")}),
    )

    def found(*args):
        return {r.constraint_name: r.violations for r in constraints.violations(*args).collect()}

    keys = "customer_key", "date_key"
    assert found(fact, "domains", constraints.FACT_RULES, "account_month", *keys) == {"domains": 3, "account_month": 1}
    # A third copy is still one repeated key.
    more = fact.unionByName(fact.filter("customer_key = 1"))
    assert found(more, None, [], "account_month", *keys) == {"account_month": 1}
    wrong = seeds.thresholds(spark).withColumn("direction", F.lit("SIDEWAYS"))
    assert found(wrong, "direction", constraints.THRESHOLD_RULES, None, "metric_name") == {"direction": 4}
    assert found(fact.limit(0), "domains", constraints.FACT_RULES, None, *keys) == {"domains": 0}


def test_very_large_revenue(fact_of, suite_of):
    huge = {"monthly_revenue": D("9999999999999999.99")}
    fact = fact_of(*[(k, at, huge) for k in range(20) for at in ("2024-01", "2024-02")])
    suite = suite_of(fact)
    total = 20 * D("9999999999999999.99")
    assert {r.mrr for r in suite.mrr.collect()} == {total}
    assert only(dashboard.region_mix(suite.mix)).mrr == 2 * total
    assert only(dashboard.drilldown_kpis(suite.drill)).mrr == 2 * total


def test_change_needs_more_than_nine_decimals(fact_of):
    # +0.00499999998 % is below the half, although nine decimals of the fraction are not.
    fact = fact_of(
        (1, "2024-01", {"monthly_revenue": D("50000000000.00")}),
        (1, "2024-02", {"monthly_revenue": D("50002499999.99")}),
    )
    assert only(marts.alerts(fact)).mrr_change_pct == 0.0
