"""The load job: keys, rejects, reruns, audit, layout, files."""

import datetime
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import DATA, month, only, staging_row
from tidemark import schemas as S
from tidemark.operators import audit, marts
from tidemark.operators import fact as facts
from tidemark.plans import load
from tidemark.plans.suite import VIEWS, StoredSuite, Suite, fetch_view, publish
from tidemark.sources import orders, seeds, staging, warehouse
from tidemark.sources.warehouse import (
    AT_RISK,
    BITS,
    CALENDAR,
    CELLS,
    COHORTS,
    CUSTOMER_MONTHS,
    CUSTOMERS,
    FACT,
    LOG,
    REJECTS,
    STAGING,
    THRESHOLDS,
    Warehouse,
)
from tidemark.streaming.refresh import refresh


@pytest.fixture
def wh(spark, tmp_path):
    return Warehouse(spark, tmp_path / "wh", buckets=4)


def _accounts(n, at="2024-01", **values):
    return [staging_row(f"CUST_{k:04d}", at, **values) for k in range(n)]


def test_load_and_rerun(wh, staging_of):
    stg = staging_of(*_accounts(20), *_accounts(10, "2024-02", cohort_month=month("2024-01")))
    first = load.run(wh, stg, "manual:test")
    assert (first.rows_loaded, first.rows_rejected, first.status) == (30, 0, "SUCCESS")
    again = load.run(wh, stg, "manual:test")
    assert again.rows_loaded == 0
    assert wh.read(FACT).count() == 30 and wh.read(CUSTOMERS).count() == 20
    log = wh.read(LOG).orderBy("log_id").collect()
    assert [(r.log_id, r.rows_loaded, r.status) for r in log] == [(1, 30, "SUCCESS"), (2, 0, "SUCCESS")]


def test_incremental_load(wh, staging_of):
    load.run(wh, staging_of(*_accounts(10)))
    load.run(wh, staging_of(*_accounts(12, "2024-02", cohort_month=month("2024-01"))))
    fact = wh.read(FACT)
    assert fact.count() == 22
    assert fact.select("sub_key").distinct().count() == 22
    customers = wh.read(CUSTOMERS)
    assert customers.count() == customers.select("customer_key").distinct().count() == 12
    assert facts.orphans(fact, customers, "customer_key").count() == 0
    # Staging is a full refresh: it holds the last batch only.
    assert wh.read(STAGING).count() == 12


def _rejects(wh):
    return {r.reject_reason: r.rows_rejected for r in staging.reject_counts(wh.read(REJECTS)).collect()}


def test_second_row_of_an_account_and_month_is_refused_and_kept(wh, staging_of):
    rows = [staging_row(), staging_row(churn_flag=1), staging_row(churn_flag=1), staging_row("CUST_B")]
    result = load.run(wh, staging_of(*rows))
    assert (result.rows_loaded, result.rows_rejected, result.status) == (2, 2, "PARTIAL")
    assert _rejects(wh) == {"repeated_account_month": 2}
    row = only(marts.mrr_monthly(wh.read(FACT)))
    assert (row.mrr, row.active_customers, row.churn_rate) == (200, 2, 0)


def test_corrections_are_counted_and_kept(wh, staging_of):
    load.run(wh, staging_of(*_accounts(30)))
    fixed = _accounts(20, monthly_revenue=Decimal("120.00")) + _accounts(30)[20:]
    result = load.run(wh, staging_of(*fixed))
    assert (result.rows_loaded, result.rows_rejected, result.status) == (0, 20, "PARTIAL")
    assert _rejects(wh) == {"differs_from_stored": 20}
    assert wh.read(REJECTS).filter(F.col("row").contains('"monthly_revenue":120.0')).count() == 20
    assert wh.read(FACT).filter("monthly_revenue <> 100").count() == 0


def test_one_bad_date_does_not_move_the_newest_month(wh, staging_of):
    bad = [staging_row("CUST_X", "2099-01"), staging_row("CUST_Y")]
    bad[1] = tuple(datetime.date(2024, 3, 15) if v == month("2024-01") else v for v in bad[1])
    result = load.run(wh, staging_of(*_accounts(20, "2024-02"), *bad))
    assert (result.rows_loaded, result.rows_rejected) == (20, 2)
    assert _rejects(wh) == {"month_outside_calendar": 2}
    assert Suite.over(wh).at_risk.count() == 20


def test_calendar_grows_by_argument_only(wh, staging_of):
    stg = staging_of(staging_row(at="2024-01"), staging_row(at="2024-02"))
    first = load.run(wh, stg, calendar=("2023-01-01", "2024-01-01"))
    assert (first.rows_loaded, first.rows_rejected) == (1, 1)
    second = load.run(wh, stg, calendar=("2024-01-01", "2024-03-01"))
    assert (second.rows_loaded, second.rows_rejected) == (1, 0)
    calendar = wh.read(CALENDAR)
    assert calendar.count() == calendar.select("date_key").distinct().count() == 15


def test_conflicting_attributes_make_one_customer(wh, staging_of):
    load.run(
        wh,
        staging_of(
            staging_row("CUST_A", "2024-01", region="LATAM", channel="Partner"),
            staging_row("CUST_A", "2024-02", region="EMEA", channel="Marketplace"),
        ),
    )
    row = only(wh.read(CUSTOMERS))
    # One of the two attribute sets as a whole, never a mixture.
    assert (row.region, row.channel) in {("LATAM", "Partner"), ("EMEA", "Marketplace")}
    assert wh.read(FACT).count() == 2


def test_existing_customer_keeps_first_attributes(wh, staging_of):
    load.run(wh, staging_of(staging_row("CUST_A", "2024-01", channel="Partner")))
    load.run(wh, staging_of(staging_row("CUST_A", "2024-02", channel="Self-Serve")))
    assert only(wh.read(CUSTOMERS)).channel == "Partner"


def test_rejects(wh, spark, staging_of):
    stg = staging_of(
        staging_row("CUST_OK"),
        staging_row("CUST_1", plan_type="Platinum"),
        staging_row("CUST_2", "2019-01"),
        staging_row("CUST_3", churn_flag=2),
        staging_row("CUST_4", usage_score=Decimal("1.200")),
        staging_row("CUST_5", region=None),
    )
    result = load.run(wh, stg, calendar=("2024-01-01", "2024-12-01"))
    assert _rejects(wh) == {
        "unknown_plan": 1,
        "month_outside_calendar": 1,
        "flag_not_0_or_1": 1,
        "usage_out_of_range": 1,
        "missing_value": 1,
    }
    assert (result.rows_loaded, result.rows_rejected, result.status) == (1, 5, "PARTIAL")


def test_batch_of_rejects_only(wh, staging_of):
    load.run(wh, staging_of(*_accounts(3)))
    result = load.run(wh, staging_of(staging_row("CUST_X", plan_type="Platinum")))
    assert (result.rows_loaded, result.rows_rejected, result.status) == (0, 1, "PARTIAL")
    assert wh.read(FACT).count() == 3 and wh.read(CUSTOMERS).count() == 3


def test_failure_is_audited_and_raised(wh, spark, staging_of):
    broken = staging_of(staging_row()).withColumn("month", F.raise_error(F.lit("unreadable input")).cast("date"))
    with pytest.raises(Exception, match="unreadable input"):
        load.run(wh, broken, "scheduler")
    row = only(wh.read(LOG))
    assert row.status == "FAILED" and "unreadable input" in row.error_message and row.rows_loaded == 0


def test_csv_round_trip_and_bad_fields(spark, tmp_path, staging_of):
    rows = _accounts(5, usage_score=Decimal("0.125"))
    staging.write_csv(staging_of(*rows), str(tmp_path / "csv"))
    back = staging.read_csv(spark, str(tmp_path / "csv"))
    assert back.filter(F.col(staging.FAULT).isNotNull()).count() == 0
    back = back.select(*staging.COLUMNS)
    assert back.schema == S.STAGING
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    (tmp_path / "bad.csv").write_text(
        ",".join(S.STAGING.fieldNames())
        + "\nCUST_X,2024-01-01,EMEA,Growth,Partner,Mid-Market,ten,0,1,0.5,0,0,2024-01-01\n"
    )
    assert only(staging.read_csv(spark, str(tmp_path / "bad.csv"))).monthly_revenue is None


def test_damaged_lines_keep_their_text(wh, spark, tmp_path):
    good = "CUST_{},2024-01-01,EMEA,Growth,Partner,Mid-Market,10.50,0,1,0.5,0,0,2024-01-01"
    lines = {
        good.format("OK"): None,
        '"CUST Q, R"' + good.format("")[5:]: None,
        good.format("MORE") + ",late,more": "surplus_fields",
        good.format("LESS")[:-14]: "missing_fields",
        '"' + good.format("QUOTE"): "broken_quote",
        good.format("TEXT").replace("10.50", "1O.5O").replace("0.5,", "half,"): "unparsable_value",
        good.format("EMPTY").replace("EMEA", ""): "missing_value",
        good.format("PLAN").replace("Growth", "Platinum"): "unknown_plan",
    }
    (tmp_path / "in.csv").write_text("\n".join([",".join(staging.COLUMNS), *lines]) + "\n")
    result = load.run(wh, staging.read_csv(spark, str(tmp_path / "in.csv")))
    assert (result.rows_loaded, result.rows_rejected) == (2, 6)
    kept = {r.reject_reason: json.loads(r.row) for r in wh.read(REJECTS).collect()}
    assert set(kept) == set(lines.values()) - {None}
    for line, reason in lines.items():
        if reason in ("surplus_fields", "missing_fields", "broken_quote"):
            assert kept[reason]["line"] == line
    assert json.loads(kept["unparsable_value"]["line"]) == {"monthly_revenue": "1O.5O", "usage_score": "half"}
    assert kept["unknown_plan"]["plan_type"] == "Platinum"


def test_csv_with_other_columns_fails_and_is_audited(wh, spark, tmp_path):
    names = S.STAGING.fieldNames()
    names[2], names[3] = names[3], names[2]
    (tmp_path / "swapped.csv").write_text(
        ",".join(names) + "\nCUST_X,2024-01-01,Growth,EMEA,Partner,Mid-Market,10,0,1,0.5,0,0,2024-01-01\n"
    )
    with pytest.raises(Exception, match="(?i)header"):
        load.run(wh, staging.read_csv(spark, str(tmp_path / "swapped.csv")))
    assert only(wh.read(LOG)).status == "FAILED"


def test_coerce_loose_rows(spark):
    text = spark.createDataFrame([staging_row()], S.STAGING)
    text = text.select(*[F.col(c).cast("string").alias(c) for c in text.columns])
    assert staging.coerce(text).schema.simpleString() == S.STAGING.simpleString()
    assert tuple(only(staging.coerce(text))) == staging_row()


def test_new_application_reads_the_same_layout(wh, spark, staging_of):
    load.run(wh, staging_of(*_accounts(200)))
    for table in (FACT, CUSTOMERS, STAGING):
        spark.sql(f"DROP TABLE {wh._name(table)}")  # external: the files stay
    later = Warehouse(spark, wh.root, buckets=16)
    assert later.read(FACT).count() == 200
    plan = later.read(FACT).groupBy("customer_key").count()._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan
    load.run(later, staging_of(*_accounts(200, "2024-02", cohort_month=month("2024-01"))))
    assert later.read(FACT).count() == 400
    assert later.layout() == 4


def test_an_account_cannot_heat_a_bucket(wh, spark, staging_of):
    """Over several loads an account repeats its rows a hundred times; one row a month is stored."""
    for at in ("2024-01", "2024-02", "2024-03"):
        hot = staging_of(staging_row("CUST_HOT", at)).join(spark.range(100)).drop("id")
        result = load.run(wh, staging_of(*_accounts(100, at)).unionByName(hot))
        assert (result.rows_loaded, result.rows_rejected) == (101, 99)
    assert wh.layout() == 4
    per_customer = wh.read(FACT).groupBy("customer_key").count().agg(F.max("count")).first()[0]
    assert per_customer == 3
    assert load.run(wh, staging_of(*_accounts(100))).rows_loaded == 0


def test_compaction_keeps_rows_and_bounds_files(wh, staging_of):
    for k in range(3):
        load.run(wh, staging_of(*[staging_row(f"CUST_{k}{j}") for j in range(20)]))
    before = sorted(map(tuple, wh.read(FACT).collect()))
    load.compact(wh)
    assert sorted(map(tuple, wh.read(FACT).collect())) == before
    assert len(wh.read(FACT).inputFiles()) <= 4
    assert wh.published().loads == [4]
    assert "Bucketed: true" in wh.read(FACT).groupBy("customer_key").count()._jdf.queryExecution().toString()
    assert load.run(wh, staging_of(staging_row("CUST_NEW", "2024-02"))).rows_loaded == 1


# What the readers of a warehouse see, for comparison before and after.
def _seen(wh):
    suite, board = Suite.over(wh), StoredSuite.over(wh)
    frames = {name: getattr(board, name) for name in ("mrr", "drill", "cohorts", "at_risk", "alerts", "mix", "health")}
    frames |= {"fact": suite.fact, "customers": suite.customers, "staging": wh.read(STAGING), "calendar": wh.read(CALENDAR)}
    rejects = wh.get(REJECTS)
    if rejects is not None:
        frames["rejects"] = rejects
    return {name: sorted(map(repr, df.collect())) for name, df in frames.items()}


STEPS = [CALENDAR, STAGING, REJECTS, CUSTOMERS, FACT, CELLS, BITS, COHORTS, AT_RISK, "publication"]


@pytest.mark.parametrize("fails_at", STEPS)
def test_a_load_that_fails_is_not_seen(wh, staging_of, fails_at):
    load.run(wh, staging_of(*_accounts(8), staging_row("CUST_BAD", plan_type="Platinum")), calendar=("2023-01-01", "2024-06-01"))
    before = _seen(wh)
    batch = staging_of(*_accounts(10, "2024-02", cohort_month=month("2024-01")), staging_row("CUST_WORSE", plan_type="Platinum"))

    def fault(name):
        if name == fails_at:
            raise OSError(f"lost at {name}")

    with pytest.raises(OSError, match="lost at"):
        load.run(wh, batch, step=fault, calendar=("2024-01-01", "2024-09-01"))
    assert _seen(wh) == before
    last = wh.read(LOG).orderBy(F.desc("log_id")).first()
    assert (last.log_id, last.status, last.rows_loaded) == (2, "FAILED", 0)
    # The same batch again: everything appears, once.
    result = load.run(wh, batch, calendar=("2024-01-01", "2024-09-01"))
    assert (result.rows_loaded, result.rows_rejected) == (10, 1)
    fact, customers = wh.read(FACT), wh.read(CUSTOMERS)
    assert fact.count() == fact.select("sub_key").distinct().count() == 18
    assert sorted(r.customer_key for r in customers.collect()) == list(range(1, 11))
    assert wh.read(CALENDAR).count() == 21
    assert_marts_equal_a_full_build(wh)


def test_a_load_is_seen_as_a_whole(wh, staging_of):
    """A reader that has begun keeps seeing what it began with."""
    load.run(wh, staging_of(*_accounts(5)))
    suite = StoredSuite.over(wh)
    before = suite.mrr.collect()
    load.run(wh, staging_of(*_accounts(7, "2024-02", cohort_month=month("2024-01"))))
    assert suite.mrr.collect() == before and suite.at_risk.count() == 5
    assert Suite.over(wh).fact.count() == 12 and StoredSuite.over(wh).mrr.count() == 2


def test_of_two_loads_at_once_one_is_refused(wh, spark, staging_of):
    load.run(wh, staging_of(*_accounts(3)))
    other = Warehouse(spark, wh.root, buckets=4)

    def meanwhile(name):
        if name == "publication":
            load.run(other, staging_of(*_accounts(4, "2024-02", cohort_month=month("2024-01"))), "first")

    with pytest.raises(warehouse.Superseded):
        load.run(wh, staging_of(*_accounts(5, "2024-03", cohort_month=month("2024-01"))), "second", step=meanwhile)
    log = {r.triggered_by: (r.status, r.rows_loaded) for r in wh.read(LOG).collect()}
    assert log["first"] == ("SUCCESS", 4) and log["second"] == ("FAILED", 0)
    assert wh.read(LOG).select("log_id").distinct().count() == 3
    assert wh.read(FACT).count() == 7
    assert load.run(wh, staging_of(*_accounts(5, "2024-03", cohort_month=month("2024-01")))).rows_loaded == 5
    assert_marts_equal_a_full_build(wh)


def assert_marts_equal_a_full_build(wh):
    live, board = Suite.over(wh), StoredSuite.over(wh)
    distinct = live.fact.groupBy("region").agg(F.countDistinct("customer_key").alias("n")).collect()
    assert {r.region: r.n for r in distinct} == {r.region: r.customers for r in board.distinct_customers("region").collect()}
    early = live.fact.filter("date_key <= '2024-02-01'").agg(F.countDistinct("customer_key")).first()[0]
    assert only(board.distinct_customers(last=month("2024-02"))).customers == early
    for name in ("mrr", "drill", "cohorts", "at_risk", "alerts", "mix", "health", "region_months", "region_totals"):
        a, b = getattr(live, name), getattr(board, name)
        assert a.dtypes == b.select(*a.columns).dtypes, name
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect())), name


def test_a_load_of_one_month_reads_and_writes_that_month(wh, spark, staging_of):
    for at in ("2024-01", "2024-02", "2024-03"):
        load.run(wh, staging_of(*_accounts(9, at, cohort_month=month("2024-01"))))
    state = wh.published()
    assert state.cells == {"2024-01-01": 1, "2024-02-01": 2, "2024-03-01": 3} == state.cohorts
    opened = []

    def watch(name):
        if name == FACT:
            # Without them, a load that opened an earlier month would fail.
            fs, folders = wh._folders(*[f"{wh.path(FACT)}/load_id={k}" for k in (1, 2, 3)])
            for folder in folders:
                hidden = wh._folders(folder.toString() + ".away")[1][0]
                assert fs.rename(folder, hidden)
                opened.append((fs, folder, hidden))

    load.run(wh, staging_of(*_accounts(12, "2024-04", cohort_month=month("2024-01"))), step=watch)
    for fs, folder, hidden in opened:
        fs.rename(hidden, folder)
    wh.forget_listings()
    assert len(opened) == 3 and wh.published().cells["2024-04-01"] == 4
    assert_marts_equal_a_full_build(wh)


def test_late_rows_move_a_cohort(wh, staging_of):
    """Rows of an earlier month than any before: customers change cohort in all their months."""
    load.run(wh, staging_of(*_accounts(9, "2024-03"), *_accounts(6, "2024-04")))
    load.run(wh, staging_of(*_accounts(4, "2024-05")))
    load.run(wh, staging_of(*_accounts(3, "2024-01"), staging_row("CUST_0001", "2024-02", region="APAC", churn_flag=1)))
    state = wh.published()
    assert state.cells["2024-03-01"] == 1 and set(state.cohorts.values()) == {3}
    assert_marts_equal_a_full_build(wh)
    months = wh.read(CUSTOMER_MONTHS).groupBy("customer_key").agg(F.min("first_month").alias("m")).collect()
    fact = wh.read(FACT).groupBy("customer_key").agg(F.min("date_key").alias("m")).collect()
    assert sorted(months) == sorted(fact)


def test_corrections_replace_rows_on_request(wh, spark, staging_of):
    load.run(wh, staging_of(*_accounts(6), *_accounts(6, "2024-02")))
    load.run(wh, staging_of(*_accounts(6, "2024-03")))
    before = {r.customer_key: r.sub_key for r in wh.read(FACT).filter("date_key = '2024-02-01'").collect()}
    # Two rows are worth more, one moves to another region, one is new, the rest is as it was.
    rows = _accounts(6, "2024-02")
    rows[:2] = _accounts(2, "2024-02", monthly_revenue=Decimal("250.00"))
    rows[2] = staging_row("CUST_0002", "2024-02", region="LATAM")
    result = load.run(wh, staging_of(*rows, staging_row("CUST_NEW", "2024-02")), correct=True)
    assert (result.rows_loaded, result.rows_rejected, result.status) == (4, 0, "SUCCESS")
    now = wh.read(FACT).filter("date_key = '2024-02-01'")
    assert now.count() == 7 and now.agg(F.sum("monthly_revenue")).first()[0] == 2 * 250 + 5 * 100
    kept = {r.customer_key: r.sub_key for r in now.collect()}
    assert sum(kept[k] == v for k, v in before.items()) == 3
    assert wh.read(FACT).count() == 19 == wh.read(FACT).select("sub_key").distinct().count()
    # What was replaced stays in the files of the load that wrote it.
    old = spark.table(wh._name(FACT)).filter("load_id = 1 AND date_key = '2024-02-01'")
    assert old.agg(F.sum("monthly_revenue")).first()[0] == 600
    assert_marts_equal_a_full_build(wh)
    # Corrections of corrections, and an ordinary load after them.
    load.run(wh, staging_of(*_accounts(1, "2024-02", monthly_revenue=Decimal("1.00"))), correct=True)
    load.run(wh, staging_of(*_accounts(6, "2024-04")))
    assert wh.read(FACT).filter("date_key = '2024-02-01'").agg(F.sum("monthly_revenue")).first()[0] == 1 + 250 + 5 * 100
    assert_marts_equal_a_full_build(wh)
    load.compact(wh)
    assert wh.read(FACT).count() == 25
    assert_marts_equal_a_full_build(wh)


def test_assigned_keys_have_no_gaps(wh, spark, staging_of):
    spread = staging_of(*[staging_row(f"CUST_{k}") for k in range(57)]).repartition(13)
    load.run(wh, spread)
    load.run(wh, staging_of(staging_row("CUST_X", plan_type="Platinum")))
    load.run(wh, staging_of(*[staging_row(f"LATE_{k}", "2024-02") for k in range(31)]).repartition(7))
    load.run(wh, staging_of(*[staging_row(f"LAST_{k}", "2024-02") for k in range(5)]))
    assert sorted(r.customer_key for r in wh.read(CUSTOMERS).collect()) == list(range(1, 94))


def test_thresholds_and_policy_change(wh, staging_of):
    load.run(wh, staging_of(staging_row(), staging_row("CUST_B", region="APAC")))
    wh.set_threshold("avg_risk_score", by="ana", critical_threshold=Decimal("99.5"), enabled=False)
    rows = {r.metric_name: r for r in wh.read(THRESHOLDS).collect()}
    changed = rows["avg_risk_score"]
    assert (changed.critical_threshold, changed.enabled, changed.last_updated_by) == (Decimal("99.5"), False, "ana")
    assert changed.last_updated_at > rows["mrr_drop_pct"].last_updated_at and len(rows) == 4
    for wrong in ({"metric": "no_metric", "enabled": True}, {"metric": "mrr_drop_pct"}, {"metric": "mrr_drop_pct", "direction": "UP"}):
        with pytest.raises((LookupError, ValueError)):
            wh.set_threshold(by="ana", **wrong)
    wh.set_policy("ana", ["APAC"])
    assert StoredSuite.over(wh, user="ana").at_risk.count() == 1
    wh.set_policy("ana", [])
    assert StoredSuite.over(wh, user="ana").at_risk.count() == 0 and wh.regions_of("bi_analyst_emea") == ["EMEA"]


def test_too_many_regions_are_refused(wh, staging_of):
    rows = [staging_row(f"CUST_{k}", region=f"R{k}") for k in range(1200)]
    with pytest.raises(ValueError, match="regions"):
        load.run(wh, staging_of(*rows))
    assert wh.get(FACT) is None and only(wh.read(LOG)).status == "FAILED"


def test_replaced_tables_are_swapped(wh, spark, staging_of):
    load.run(wh, staging_of(*_accounts(3)))
    path = wh.path(THRESHOLDS)
    # A driver lost between the two renames: the old rows are found again.
    fs, (now, old) = wh._folders(path, path + ".old")
    fs.rename(now, old)
    assert wh.read(THRESHOLDS).count() == 4


def test_purge_log_drops_expired_days(wh, staging_of):
    first, later = datetime.datetime(2024, 1, 1, 12), datetime.datetime(2024, 4, 1, 12)
    load.run(wh, staging_of(staging_row()), at=first)
    load.run(wh, staging_of(staging_row(at="2024-02")), at=later)
    files = set(wh.read(LOG).inputFiles())
    # The first day as a whole is 90 days old only a day later.
    assert load.purge_log(wh, F.lit(later - datetime.timedelta(days=2))) == []
    assert load.purge_log(wh, F.lit(later)) == ["day=2024-01-01"]
    assert [r.log_id for r in wh.read(LOG).collect()] == [2] and set(wh.read(LOG).inputFiles()) < files
    load.run(wh, staging_of(staging_row(at="2024-03")), at=later)
    assert sorted(r.log_id for r in wh.read(LOG).collect()) == [2, 3]
    assert audit.retained(wh.read(LOG), F.lit(later + datetime.timedelta(days=91))).count() == 0


def test_verify(wh, staging_of):
    load.run(wh, staging_of(*_accounts(3), *_accounts(3, "2024-03")), "manual:me")
    counts, newest = load.verify(wh)
    assert {r.table_name: r.row_count for r in counts.collect()} == {
        "dim_customer": 3,
        "dim_plan": 4,
        "dim_date": 600,
        "fact_subscriptions": 6,
        "stg_subscriptions": 6,
        "refresh_log": 1,
    }
    assert only(newest).triggered_by == "manual:me"


def test_views(wh, spark, staging_of):
    load.run(wh, staging_of(*_accounts(3), *_accounts(3, "2024-02")))
    assert set(publish(Suite.over(wh))) == set(VIEWS)
    months = [r.month for r in fetch_view(spark, "v_mrr_monthly").collect()]
    assert months == [month("2024-01"), month("2024-02")]
    assert fetch_view(spark, "v_revenue_mix", [("month", False)], 1).first().month == month("2024-02")
    assert len(fetch_view(spark, "v_refresh_log").columns) == 9
    assert spark.sql("SELECT sum(mrr) AS m FROM v_revenue_drilldown").first().m == 600
    with pytest.raises(ValueError):
        fetch_view(spark, "v_unknown")


def test_refresh_loads_only_new_files(wh, spark, tmp_path, staging_of):
    inbox = tmp_path / "inbox"

    def arrive(name, rows):
        staging_of(*rows).coalesce(1).write.mode("append").option("header", True).csv(str(inbox))

    arrive("a", _accounts(4))
    refresh(wh, str(inbox), str(tmp_path / "seen"))
    assert wh.read(FACT).count() == 4
    arrive("b", _accounts(5, "2024-02", cohort_month=month("2024-01")))
    refresh(wh, str(inbox), str(tmp_path / "seen"))
    assert wh.read(FACT).count() == 9 and wh.read(CUSTOMERS).count() == 5
    assert wh.read(STAGING).count() == 5
    refresh(wh, str(inbox), str(tmp_path / "seen"))
    assert wh.read(LOG).count() == 2


def test_command_line(spark, tmp_path, staging_of, capsys):
    staging.write_csv(staging_of(*_accounts(3)), str(tmp_path / "in"))
    load.main(["--csv", str(tmp_path / "in"), "--warehouse", str(tmp_path / "cli"), "--buckets", "2"])
    assert "rows_loaded=3" in capsys.readouterr().out


def test_orders_staging_keeps_every_account_month(spark):
    stg = orders.staging_from(spark, DATA).cache()
    assert stg.count() == stg.select("customer_id", "month").distinct().count() == 1411
    total = spark.read.parquet(f"{DATA}/orders.parquet").agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)"))).first()[0]
    assert stg.agg(F.sum("monthly_revenue")).first()[0] == total


def test_churn_is_observed(spark):
    stg = orders.staging_from(spark, DATA).select("customer_key", "month", "churn_flag").collect()
    months = {}
    for r in stg:
        months.setdefault(r.customer_key, []).append(r.month.year * 12 + r.month.month)
    last = max(max(m) for m in months.values())
    for r in stg:
        at = r.month.year * 12 + r.month.month
        quiet = not any(at < m <= at + orders.CHURN_MONTHS for m in months[r.customer_key])
        assert r.churn_flag == int(quiet and at + orders.CHURN_MONTHS <= last)
    assert 0 < sum(r.churn_flag for r in stg) < len(stg)


def test_skewed_orders_give_the_same_staging(spark):
    """A third of all orders on one account, and one order with a third of all lines."""
    tables = orders.read_tables(spark, DATA)
    hot = tables["orders"].withColumn(
        "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("bigint")).otherwise(F.col("o_custkey"))
    )
    lines = tables["lineitem"].withColumn(
        "l_orderkey", F.when(F.col("l_orderkey") % 3 == 0, F.lit(3).cast("bigint")).otherwise(F.col("l_orderkey"))
    )
    stg = orders.staging(hot, lines, tables["customer"], tables["nation"], tables["region"])
    base = hot.groupBy(
        F.col("o_custkey").alias("customer_key"), F.trunc("o_orderdate", "MM").alias("month")
    ).agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("want"))
    joined = stg.join(base, ["customer_key", "month"])
    assert joined.count() == stg.count() > 0
    assert joined.filter("monthly_revenue <> want").count() == 0


def test_bucket_count():
    assert warehouse.bucket_count(0) == 1
    assert warehouse.bucket_count(1000 * warehouse.BUCKET_BYTES) == 1000


def test_seed_tables(spark):
    assert seeds.plans(spark).count() == seeds.regions(spark).count() == 4
    assert only(seeds.region_policy(spark).filter("db_user = 'bi_analyst_na'")).region == "North America"
    limits = {r.metric_name: r.critical_threshold for r in seeds.thresholds(spark).collect()}
    assert limits["mrr_drop_pct"] == Decimal("-0.10") and limits["avg_risk_score"] == 70


def test_created_at_and_loaded_at_are_set(wh, staging_of):
    before = datetime.datetime.now() - datetime.timedelta(minutes=5)
    load.run(wh, staging_of(staging_row()))
    assert only(wh.read(FACT)).loaded_at > before and only(wh.read(CUSTOMERS)).created_at > before


@pytest.mark.parametrize("session_partitions", ["3", "200"])
def test_one_file_per_bucket(spark, tmp_path, session_partitions):
    wh = Warehouse(spark, tmp_path / f"files{session_partitions}", buckets=6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", session_partitions)
    try:
        stg = orders.staging_from(spark, DATA, wh.buckets)
        load.run(wh, stg, input_bytes=warehouse.planned_bytes(stg), account_grain=True)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for table in (STAGING, CUSTOMERS):
        assert len(wh.read(table).inputFiles()) <= 6, table
    assert len(wh.read(FACT).inputFiles()) <= 6 * wh.read(FACT).select("date_key").distinct().count()
