"""Named queries over a folder of order tables.

The first query on a folder runs the load job once per application and
writes the star schema; every query then reads those tables, as a user of the
suite would. The tables go to the shared folder named by
``spark.checkpoint.dir``. Only a local session without that setting uses a
temporary folder of its own.
"""

import tempfile
import threading
import time
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import anon_id, risk_score
from tidemark.operators import alerting, audit, constraints, dashboard, security
from tidemark.operators import fact as facts
from tidemark.plans import load
from tidemark.plans.suite import StoredSuite, Suite, fetch_view, publish
from tidemark.session import pin_runtime
from tidemark.sources import orders, seeds, staging, warehouse

# Fixed inputs of single queries; plans.oracle uses the same values.
ANALYST = "bi_analyst_emea"
RELOAD_DAYS = 100
CORRECTED_MONTHS = 12

_roots: dict[tuple, str] = {}
_exports: set[str] = set()
_lock = threading.RLock()


def shared_folder(spark) -> str:
    """The cluster's shared folder; a temporary one only in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return f"{named.rstrip('/')}/tidemark/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


def input_bytes(spark, sf_dir) -> int:
    return sum(map(warehouse.planned_bytes, orders.read_tables(spark, sf_dir).values()))


def new_warehouse(spark, sf_dir, label) -> warehouse.Warehouse:
    """An empty warehouse sized for the folder's tables.

    An account and month has an order at least, and files tell how many orders they hold.
    """
    root = f"{shared_folder(spark)}/{label}-{time.time_ns()}"
    orders_held = orders.read_tables(spark, sf_dir)["orders"].count()
    return warehouse.Warehouse.sized_for(spark, root, input_bytes(spark, sf_dir), orders_held)


def _warehouse(spark, sf_dir, label, fill) -> warehouse.Warehouse:
    """A warehouse filled once per application and content of the folder."""
    files = warehouse.listing(spark, [f"{sf_dir}/{name}.parquet" for name in orders.TABLES])
    key = (spark.sparkContext.applicationId, files, label)
    with _lock:
        if key not in _roots:
            wh = new_warehouse(spark, sf_dir, label)
            fill(wh)
            _roots[key] = (wh.root, wh.buckets)
        root, buckets = _roots[key]
    return warehouse.Warehouse(spark, root, buckets)


def load_orders(wh, sf_dir) -> load.LoadResult:
    """Staging from the order tables, and the star schema from it."""
    stg = orders.staging_from(wh.spark, sf_dir, wh.buckets)
    return load.run(wh, stg, input_bytes=input_bytes(wh.spark, sf_dir), account_grain=True)


def loaded_warehouse(spark, sf_dir) -> warehouse.Warehouse:
    """The warehouse of a folder, loaded on first use in this application."""
    pin_runtime(spark)

    return _warehouse(spark, sf_dir, "warehouse", lambda wh: load_orders(wh, sf_dir))


# ---- sources and load -------------------------------------------------------


def _staged(spark, sf_dir):
    return loaded_warehouse(spark, sf_dir).read(warehouse.STAGING)


def stg_subscriptions(spark, sf_dir):
    return _staged(spark, sf_dir).select(*staging.COLUMNS)


def staging_from_csv(spark, sf_dir):
    """Staging as a CSV with a header, read back as text and coerced."""
    csv = _csv_of(spark, sf_dir)
    return staging.coerce(staging.read_csv_text(spark, csv))


def _csv_of(spark, sf_dir) -> str:
    """The staging rows as CSV files, written once per warehouse."""
    wh = loaded_warehouse(spark, sf_dir)
    path = f"{wh.root}/export/staging-csv"
    with _lock:
        if path not in _exports:
            staging.write_csv(wh.read(warehouse.STAGING), path)
            _exports.add(path)
    return path


def anon_customer_id(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    text = F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))
    return customer.select("c_custkey", anon_id(text).alias("customer_id"))


def risk_scores(spark, sf_dir):
    inputs = ["customer_id", "month", "failed_payments", "support_tickets", "usage_score"]
    return _staged(spark, sf_dir).select(*inputs, risk_score().alias("churn_risk_score"))


def plan_usage(spark, sf_dir):
    """Account-months on each plan."""
    used = _suite(spark, sf_dir).fact.groupBy("plan_key").agg(F.count("*").alias("n"))
    return (
        seeds.plans(spark)
        .join(used, "plan_key", "left")
        .withColumn("account_months", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


def region_usage(spark, sf_dir):
    """Account-months in each region."""
    used = _suite(spark, sf_dir).fact.groupBy("region").agg(F.count("*").alias("n"))
    regions = seeds.regions(spark)
    return (
        regions.join(used, regions.region_name == used.region, "left")
        .withColumn("account_months", F.coalesce("n", F.lit(0)))
        .drop("n", "region")
    )


def threshold_hits(spark, sf_dir):
    """How many metric values reach the warning level of each stored threshold."""
    suite = _suite(spark, sf_dir)
    reached = (
        alerting.threshold_alerts(alerting.region_metrics(suite.fact), suite.thresholds)
        .groupBy("metric_name")
        .agg(F.count_if(F.col("severity") != "OK").alias("n"))
    )
    return (
        suite.thresholds.join(reached, "metric_name", "left")
        .withColumn("values_reached", F.coalesce("n", F.lit(0)))
        .drop("n", "last_updated_at")
    )


def dim_date(spark, sf_dir):
    """The stored calendar from the first to the last loaded month."""
    wh = loaded_warehouse(spark, sf_dir).bound()
    months = [date.fromisoformat(m) for m in wh.published().rows]
    return wh.read(warehouse.CALENDAR).filter(F.col("date_key").between(F.lit(min(months)), F.lit(max(months))))


def dim_customer(spark, sf_dir):
    return _suite(spark, sf_dir).customers.drop("created_at")


def fact_subscriptions(spark, sf_dir):
    return _suite(spark, sf_dir).fact.drop("sub_key", "loaded_at")


def natural_warehouse(spark, sf_dir) -> warehouse.Warehouse:
    """A warehouse loaded from the CSV, with assigned keys, as a monthly close goes.

    Its calendar first ends with the last complete month, so rows of the running
    month are refused and kept as rejects. Then, a good while later, the calendar is
    grown and the file loaded again: only those rows are new.
    """

    def fill(wh):
        stg = staging.coerce(staging.read_csv_text(spark, _csv_of(spark, sf_dir)))
        size = warehouse.planned_bytes(stg)
        span = _staged(spark, sf_dir).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
        span = span.withColumn("before", F.add_months("hi", -1)).first()
        close = datetime(span["hi"].year, span["hi"].month, 1, 3)
        load.run(wh, stg, "manual:close", calendar=(span["lo"], span["before"]), input_bytes=size, at=close)
        again = close + timedelta(days=RELOAD_DAYS)
        load.run(wh, stg, "manual:reload", calendar=(span["hi"], span["hi"]), input_bytes=size, at=again)

    return _warehouse(spark, sf_dir, "natural", fill)


def recovered_warehouse(spark, sf_dir) -> warehouse.Warehouse:
    """A warehouse whose second load was lost when all was written but the pointer, and was then run again."""

    def fill(wh):
        stg = _staged(spark, sf_dir)
        newest = stg.agg(F.max("month")).first()[0]
        size = input_bytes(spark, sf_dir)
        load.run(wh, stg.filter(F.col("month") < F.lit(newest)), "nightly", input_bytes=size, account_grain=True)

        def lost(name):
            if name == "publication":
                raise RuntimeError("driver lost")

        try:
            load.run(wh, stg, "nightly", input_bytes=size, account_grain=True, step=lost)
        except RuntimeError:
            load.run(wh, stg, "rerun", input_bytes=size, account_grain=True)

    return _warehouse(spark, sf_dir, "recovered", fill)


def load_after_failure(spark, sf_dir):
    """What readers found after the first load, which the lost one left alone, and after the rerun."""
    wh = recovered_warehouse(spark, sf_dir)
    phases = []
    for version, phase in ((1, "after the lost load"), (2, "after the rerun")):
        suite = StoredSuite.over(wh.bound(wh.published(version)))
        rows = audit.table_counts({"fact_subscriptions": suite.fact, "dim_customer": suite.customers})
        revenue, months = (suite.mrr.select(total).scalar() for total in (F.sum("mrr"), F.count("*")))
        phases.append(rows.withColumns({"revenue": revenue, "months": months, "phase": F.lit(phase)}))
    return reduce(DataFrame.unionByName, phases)


def load_after_failure_log(spark, sf_dir):
    return audit.without_clock(recovered_warehouse(spark, sf_dir).read(warehouse.LOG))


def without_returns(spark, sf_dir) -> DataFrame:
    """Staging rows of the last ``CORRECTED_MONTHS`` months with the revenue of orders that had no return."""
    tables = orders.read_tables(spark, sf_dir)
    returned = tables["lineitem"].filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    month = F.trunc("o_orderdate", "MM").alias("month")
    net = (
        tables["orders"]
        .join(returned, "o_orderkey", "left_anti")
        .groupBy(F.col("o_custkey").alias("customer_key"), month)
        .agg(F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast(S.REVENUE).alias("net"))
    )
    stg = _staged(spark, sf_dir)
    last = stg.select(F.add_months(F.max("month"), 1 - CORRECTED_MONTHS)).scalar()
    rows = stg.filter(F.col("month") >= last).join(net, ["customer_key", "month"], "left")
    revenue = F.coalesce("net", F.lit(0).cast(S.REVENUE))
    return rows.withColumn("monthly_revenue", revenue).drop("net").select(*stg.columns)


def corrected_warehouse(spark, sf_dir) -> warehouse.Warehouse:
    """A warehouse in which the last year's revenue was corrected after its first load."""

    def fill(wh):
        size = input_bytes(spark, sf_dir)
        load.run(wh, _staged(spark, sf_dir), "nightly", input_bytes=size, account_grain=True)
        batch = warehouse.co_locate(without_returns(spark, sf_dir), wh.layout())
        load.run(wh, batch, "correction", input_bytes=size, account_grain=True, correct=True)

    return _warehouse(spark, sf_dir, "corrected", fill)


def fact_after_corrections(spark, sf_dir):
    return Suite.over(corrected_warehouse(spark, sf_dir)).fact.drop("sub_key", "loaded_at")


def mrr_after_corrections(spark, sf_dir):
    """Revenue by month as the stored marts have it after a correction."""
    return StoredSuite.over(corrected_warehouse(spark, sf_dir)).mrr


def corrections_log(spark, sf_dir):
    return audit.without_clock(corrected_warehouse(spark, sf_dir).read(warehouse.LOG))


def damaged_lines(stg: DataFrame) -> DataFrame:
    """CSV lines of staging rows, some of them damaged the ways that files are, by account."""
    key = F.col("customer_key") % 20
    fields = [F.col(c).cast("string").alias(c) for c in staging.COLUMNS]
    text = stg.select("customer_key", *fields).withColumns(
        {
            "monthly_revenue": F.when(key == 3, F.replace("monthly_revenue", F.lit("."), F.lit("o"))).otherwise(F.col("monthly_revenue")),
            "plan_type": F.when(key == 4, "Platinum").otherwise(F.col("plan_type")),
            "usage_score": F.when(key == 5, "1.5").otherwise(F.col("usage_score")),
            "churn_flag": F.when(key == 6, "2").otherwise(F.col("churn_flag")),
            "channel": F.when(key == 7, "").otherwise(F.col("channel")),
        }
    )
    line = F.concat_ws(",", *staging.COLUMNS)
    return text.select(
        F.when(key == 0, F.concat(line, F.lit(",late,more")))
        .when(key == 1, F.regexp_replace(line, ",[^,]*,[^,]*$", ""))
        .when(key == 2, F.concat(F.lit('"'), line))
        .otherwise(line)
        .alias("value")
    )


def quarantine_warehouse(spark, sf_dir) -> warehouse.Warehouse:
    """A warehouse loaded from a file in which a part of the accounts has damaged lines."""

    def fill(wh):
        path = f"{wh.root}/inbox/lines"
        damaged_lines(_staged(spark, sf_dir)).write.text(path)
        stg = staging.read_csv(spark, path, header=False)
        load.run(wh, stg, "inbox", input_bytes=warehouse.planned_bytes(stg))

    return _warehouse(spark, sf_dir, "quarantine", fill)


def line_rejects(spark, sf_dir):
    """Refused lines by reason, with how many of them still have their text."""
    rejects = quarantine_warehouse(spark, sf_dir).read(warehouse.REJECTS)
    text = F.get_json_object("row", f"$.{staging.LINE}")
    return rejects.groupBy("reject_reason").agg(
        F.sum("copies").alias("rows_rejected"), F.count_if(text.isNotNull()).alias("with_text")
    )


def unparsed_revenue(spark, sf_dir):
    """The revenue texts that did not parse, as they stood in the lines."""
    rejects = quarantine_warehouse(spark, sf_dir).read(warehouse.REJECTS)
    text = F.get_json_object(F.get_json_object("row", f"$.{staging.LINE}"), "$.monthly_revenue")
    unread = rejects.filter("reject_reason = 'unparsable_value'")
    return unread.select(F.get_json_object("row", "$.customer_id").alias("customer_id"), text.alias("text"))


def load_rejects(spark, sf_dir):
    """Refused rows of the CSV loads by reason."""
    return staging.reject_counts(natural_warehouse(spark, sf_dir).read(warehouse.REJECTS))


def load_audit(spark, sf_dir):
    """What the load of the order tables wrote about itself."""
    return audit.without_clock(loaded_warehouse(spark, sf_dir).read(warehouse.LOG))


def load_rerun_counts(spark, sf_dir):
    """Row counts after loading the same rows twice."""
    wh = natural_warehouse(spark, sf_dir)
    tables = (warehouse.CUSTOMERS, warehouse.FACT, warehouse.LOG, warehouse.REJECTS)
    return audit.table_counts({t: wh.read(t) for t in tables})


def fact_by_natural_id(spark, sf_dir):
    """The fact under assigned keys, resolved back to customer ids and plan names."""
    suite = Suite.over(natural_warehouse(spark, sf_dir))
    return (
        suite.fact.join(suite.customers.select("customer_key", "customer_id", "channel"), "customer_key")
        .join(suite.plans.select("plan_key", "plan_name"), "plan_key")
        .drop("sub_key", "customer_key", "plan_key", "loaded_at")
    )


def _log(spark, sf_dir):
    return natural_warehouse(spark, sf_dir).read(warehouse.LOG)


def refresh_log_recent(spark, sf_dir):
    return audit.recent(_log(spark, sf_dir)).drop("run_minute", "duration_ms")


def refresh_log_latest(spark, sf_dir):
    return audit.latest(_log(spark, sf_dir)).drop("duration_ms")


def refresh_log_retained(spark, sf_dir):
    """The log rows that are kept as of the newest run."""
    log = _log(spark, sf_dir)
    return audit.without_clock(audit.retained(log, log.select(F.max("run_ts")).scalar()))


def table_counts(spark, sf_dir):
    wh = loaded_warehouse(spark, sf_dir)
    return audit.table_counts(
        {
            "dim_customer": wh.read(warehouse.CUSTOMERS),
            "dim_plan": seeds.plans(spark),
            "dim_date": wh.read(warehouse.CALENDAR),
            "fact_subscriptions": wh.read(warehouse.FACT),
            "stg_subscriptions": wh.read(warehouse.STAGING),
            "refresh_log": wh.read(warehouse.LOG),
        }
    )


def fact_orphans(spark, sf_dir):
    """Fact rows without a customer, plan or calendar row."""
    wh = loaded_warehouse(spark, sf_dir)
    suite = Suite.over(wh)
    checks = {
        "customer_key": suite.customers,
        "plan_key": suite.plans,
        "date_key": wh.read(warehouse.CALENDAR),
    }
    return audit.table_counts({name: facts.orphans(suite.fact, dim, name) for name, dim in checks.items()})


def constraint_violations(spark, sf_dir):
    """Violations of each declared constraint, in stored tables and among what the loads refused."""
    suite = Suite.over(natural_warehouse(spark, sf_dir))
    wh = suite.wh
    of = constraints.violations
    refused = wh.read(warehouse.REJECTS).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("violations"))
    parts = [
        of(suite.fact, "fact_domains", constraints.FACT_RULES, "fact_account_month", "customer_key", "date_key"),
        of(suite.customers, None, [], "customer_id", "customer_id"),
        of(wh.read(warehouse.LOG), "log_status", constraints.LOG_RULES, "log_id", "log_id"),
        of(suite.thresholds, "threshold_direction", constraints.THRESHOLD_RULES, "metric_name", "metric_name"),
        refused.select(F.lit("refused_rows").alias("constraint_name"), "violations"),
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- views ------------------------------------------------------------------


def _suite(spark, sf_dir) -> Suite:
    return Suite.over(loaded_warehouse(spark, sf_dir))


def _of(build):
    """A registered query from a function of the suite."""
    return lambda spark, sf_dir: build(_suite(spark, sf_dir))


def _stored(build, **seen):
    """A dashboard query over the marts that the last load stored."""
    return lambda spark, sf_dir: build(StoredSuite.over(loaded_warehouse(spark, sf_dir), **seen))


def _observed(build, kind=StoredSuite, **seen):
    """A latest-month query as of the newest month whose churn is in the data.

    The orders end within a month, and whoever has not ordered in it yet is not gone.
    """

    def query(spark, sf_dir):
        wh = loaded_warehouse(spark, sf_dir).bound()
        return build(kind.over(wh, as_of=date.fromisoformat(load.observed_month(wh.published())), **seen))

    return query


def published_alerts(spark, sf_dir):
    """The alert rows, read by view name in the view's order."""
    publish(_suite(spark, sf_dir), ["v_alerts"])
    return fetch_view(spark, "v_alerts")




QUERIES = {
    "mrr_monthly": _of(lambda s: s.mrr),
    "revenue_drilldown": _of(lambda s: s.drill),
    "cohort_retention": _of(lambda s: s.cohorts),
    "accounts_at_risk": _observed(lambda s: s.at_risk, Suite),
    "alerts": _of(lambda s: s.alerts),
    "active_alerts": _observed(lambda s: s.active_alerts, Suite),
    "revenue_mix": _of(lambda s: s.mix),
    "health_signals": _of(lambda s: s.health),
    "stg_subscriptions": stg_subscriptions,
    "staging_from_csv": staging_from_csv,
    "anon_customer_id": anon_customer_id,
    "risk_score": risk_scores,
    "plan_usage": plan_usage,
    "region_usage": region_usage,
    "threshold_hits": threshold_hits,
    "dim_date": dim_date,
    "dim_customer": dim_customer,
    "fact_subscriptions": fact_subscriptions,
    "fact_orphans": fact_orphans,
    "constraint_violations": constraint_violations,
    "fact_rows_json": _of(lambda s: audit.fact_rows_json(s.fact)),
    "load_rejects": load_rejects,
    "load_after_failure": load_after_failure,
    "load_after_failure_log": load_after_failure_log,
    "fact_after_corrections": fact_after_corrections,
    "mrr_after_corrections": mrr_after_corrections,
    "corrections_log": corrections_log,
    "line_rejects": line_rejects,
    "unparsed_revenue": unparsed_revenue,
    "load_audit": load_audit,
    "load_rerun_counts": load_rerun_counts,
    "fact_by_natural_id": fact_by_natural_id,
    "refresh_log_recent": refresh_log_recent,
    "refresh_log_latest": refresh_log_latest,
    "refresh_log_retained": refresh_log_retained,
    "table_counts": table_counts,
    "published_alerts": published_alerts,
    "latest_mrr_row": _stored(lambda s: dashboard.latest_mrr_row(s.mrr)),
    "overview_kpis": _stored(lambda s: dashboard.overview_kpis(s.mrr, s.at_risk)),
    "mrr_churn_trend": _stored(lambda s: dashboard.mrr_churn_trend(s.mrr)),
    "plan_mix_latest": _observed(lambda s: dashboard.plan_mix(s.mix_latest)),
    "region_mix_latest": _observed(lambda s: dashboard.region_mix(s.mix_latest)),
    "region_revenue_alltime": _stored(lambda s: dashboard.region_mix(s.mix)),
    "segment_stack": _observed(lambda s: dashboard.segment_stack(s.drill_latest)),
    "churn_by_region": _observed(lambda s: dashboard.churn_by_region(s.drill_latest)),
    "revenue_impact_top8": _stored(lambda s: dashboard.revenue_impact(s.drill)),
    "drilldown_kpis_all": _stored(lambda s: dashboard.drilldown_kpis(s.drill)),
    "drilldown_kpis_emea_growth": _stored(
        lambda s: dashboard.drilldown_kpis(s.drill, region="EMEA", plan_name="Growth")
    ),
    "drilldown_distinct_customers": _stored(
        lambda s: s.distinct_customers("plan_name", "channel", first=date(1998, 1, 1), last=date(1999, 12, 1))
    ),
    "distinct_customers_emea_growth": _stored(lambda s: s.distinct_customers(region="EMEA", plan_name="Growth")),
    "distinct_customers_by_region": _stored(lambda s: s.distinct_customers("region")),
    "risk_tier_counts": _observed(lambda s: dashboard.risk_tier_counts(s.at_risk)),
    "risk_drivers": _observed(lambda s: dashboard.risk_drivers(s.at_risk)),
    "risk_by_segment": _observed(lambda s: dashboard.risk_by_segment(s.at_risk)),
    "risk_by_region": _observed(lambda s: dashboard.risk_by_region(s.at_risk)),
    "top_risk_accounts": _observed(lambda s: dashboard.top_risk_accounts(s.at_risk)),
    "cohort_heatmap": _stored(lambda s: dashboard.cohort_heatmap(s.cohorts)),
    "alert_feed": _stored(lambda s: alerting.alert_feed(s.alerts)),
    "alert_feed_severity": _stored(lambda s: alerting.feed_severity(alerting.alert_feed(s.alerts))),
    "rls_fact_region_totals": _stored(lambda s: s.region_totals, user=ANALYST),
    "rls_mrr_monthly": _stored(lambda s: s.mrr, user=ANALYST),
    "top_risk_accounts_emea": _observed(
        lambda s: security.analyst_top_risk(dashboard.top_risk_accounts(s.at_risk), s.policy, ANALYST)
    ),
    "mrr_latest_emea": _observed(lambda s: security.visible_mrr(s.mix_latest), user=ANALYST),
    "threshold_alerts": _stored(lambda s: s.threshold_alerts),
}
