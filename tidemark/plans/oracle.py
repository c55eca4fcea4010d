"""DuckDB statements with the same results as the registered queries.

Each statement is a set of named CTEs and a body. The CTEs state the rules
again, in other terms where that is cheap (integer cents for percentages and
their rounding), so that agreement means something.
"""

from tidemark import schemas as S
from tidemark.plans.registry import CORRECTED_MONTHS, RELOAD_DAYS
from tidemark.sources.orders import CHURN_MONTHS

MONEY = "DECIMAL(28,2)"
# The region of the analyst in the seeded policy.
ANALYST_REGION = "EMEA"


def _half_up(expr, digits):
    scale = f"{10**digits}.0::DOUBLE"
    return f"(floor(({expr}) * {scale} + 0.5::DOUBLE) / {scale})"


def _percent(part, whole):
    share = f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"
    return f"CAST(coalesce(floor({share} * 100.0::DOUBLE + 0.5), 0) AS INT)"


def _churn_band(expr):
    return f"CASE WHEN {expr} >= 6 THEN 'red' WHEN {expr} >= 5 THEN 'amber' ELSE 'green' END"


def _score(failed="failed_payments", tickets="support_tickets", usage="usage_score"):
    # In hundredths: 30 = 3000, 10 = 1000, 40 * (1000 - mils) / 1000 = 4 * (1000 - mils).
    hundredths = (
        f"least(10000, {failed} * 3000 + least({tickets}, 5) * 1000"
        f" + 4 * (1000 - CAST({usage} * 1000 AS INT)))"
    )
    return f"CAST(CAST({hundredths} AS DECIMAL(18,2)) / 100 AS DECIMAL(5,2))"


# name -> (CTEs it reads, SQL)
CTES = {
    "per_order": (
        [],
        """SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS BIGINT)) AS units,
               count(*) FILTER (l_returnflag = 'R') AS returns
           FROM lineitem GROUP BY l_orderkey""",
    ),
    "account_month": (
        ["per_order"],
        """SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               sum(CAST(o_totalprice AS DECIMAL(12,2))) AS revenue,
               coalesce(sum(returns), 0) AS tickets,
               count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') AS failed,
               coalesce((sum(units) * 20) // nullif(sum(n_lines), 0), 0) AS usage_mils
           FROM orders LEFT JOIN per_order ON l_orderkey = o_orderkey
           GROUP BY ALL""",
    ),
    "account": (
        [],
        """SELECT c_custkey,
               'CUST_' || upper(substr(sha256('cust_' || c_custkey), 1, 12)) AS customer_id,
               CASE r_name
                   WHEN 'AMERICA' THEN if(n_nationkey % 2 = 0, 'North America', 'LATAM')
                   WHEN 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS region,
               CASE WHEN c_acctbal < 2500 THEN 'Starter' WHEN c_acctbal < 5500 THEN 'Growth'
                   WHEN c_acctbal < 8500 THEN 'Enterprise' ELSE 'Enterprise Plus' END AS plan_type,
               list_extract(['Direct Sales', 'Partner', 'Self-Serve', 'Marketplace'],
                   CAST(c_custkey % 4 AS INT) + 1) AS channel
           FROM customer JOIN nation ON n_nationkey = c_nationkey
           JOIN region ON r_regionkey = n_regionkey""",
    ),
    # Churned: none of the account's other months lies in the year that follows, and that year is over.
    "flagged": (
        ["account_month", "account"],
        f"""SELECT m.*, a.*, CAST(m.month + INTERVAL {CHURN_MONTHS} MONTH <= (SELECT max(month) FROM account_month)
                AND NOT EXISTS (SELECT 1 FROM account_month later WHERE later.o_custkey = m.o_custkey
                    AND later.month > m.month AND later.month <= m.month + INTERVAL {CHURN_MONTHS} MONTH)
                AS INT) AS churned
           FROM account_month m JOIN account a ON c_custkey = o_custkey""",
    ),
    "stg": (
        ["flagged"],
        """SELECT customer_id, month, region, plan_type, channel,
               CASE WHEN plan_type LIKE 'Enterprise%' THEN 'Enterprise'
                    WHEN plan_type = 'Growth' THEN 'Mid-Market' ELSE 'SMB' END AS segment,
               CAST(revenue AS DECIMAL(18,2)) AS monthly_revenue, churned AS churn_flag,
               1 AS active_flag,
               CAST(CAST(usage_mils AS DECIMAL(18,3)) / 1000 AS DECIMAL(4,3)) AS usage_score,
               CAST(tickets AS INT) AS support_tickets, CAST(failed AS INT) AS failed_payments,
               min(month) OVER (PARTITION BY c_custkey) AS cohort_month, c_custkey AS customer_key
           FROM flagged""",
    ),
    "plans": (
        [],
        """SELECT * FROM (VALUES (1, 'Starter', 1, 299.00), (2, 'Growth', 2, 1299.00),
               (3, 'Enterprise', 3, 4999.00), (4, 'Enterprise Plus', 4, 14999.00))
           AS t(plan_key, plan_name, tier_rank, base_price_usd)""",
    ),
    "thresholds": (
        [],
        """SELECT threshold_id, metric_name, CAST(w AS DECIMAL(18,6)) AS warning_threshold,
               CAST(c AS DECIMAL(18,6)) AS critical_threshold, direction, TRUE AS enabled,
               'seed' AS last_updated_by
           FROM (VALUES (1, 'monthly_churn_rate', 0.06, 0.10, 'ABOVE'),
               (2, 'mrr_drop_pct', -0.05, -0.10, 'BELOW'), (3, 'avg_risk_score', 50, 70, 'ABOVE'),
               (4, 'failed_payment_rate', 0.08, 0.15, 'ABOVE'))
           AS t(threshold_id, metric_name, w, c, direction)""",
    ),
    "customers": (
        ["stg"],
        """SELECT customer_key, customer_id, min(cohort_month) AS cohort_month, min(region) AS region,
               min(plan_type) AS plan_type, min(channel) AS channel, min(segment) AS segment
           FROM stg GROUP BY customer_key, customer_id""",
    ),
    "fact": (
        ["stg", "plans"],
        f"""SELECT customer_key, month AS date_key, plan_key, plan_name, monthly_revenue, churn_flag,
               active_flag, usage_score, support_tickets, failed_payments,
               {_score()} AS churn_risk_score, region, segment
           FROM stg JOIN plans ON plan_name = plan_type""",
    ),
    # The last year without the revenue of orders that had a line returned.
    "corrected": (
        ["fact"],
        f"""SELECT * REPLACE (CASE WHEN date_key + INTERVAL {CORRECTED_MONTHS} MONTH > (SELECT max(date_key) FROM fact)
                   THEN CAST(coalesce((SELECT sum(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders
                       WHERE o_custkey = customer_key AND date_trunc('month', o_orderdate) = date_key
                       AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')), 0) AS DECIMAL(18,2))
                   ELSE monthly_revenue END AS monthly_revenue)
           FROM fact""",
    ),
    # The newest month whose churn is in the data: rows reach a year beyond it.
    "shown": (
        ["fact"],
        f"""SELECT coalesce(max(date_key) FILTER (date_key + INTERVAL {CHURN_MONTHS} MONTH <= last), max(last)) AS month
           FROM fact, (SELECT max(date_key) AS last FROM fact)""",
    ),
    "mrr": (
        ["fact"],
        f"""SELECT month, mrr, CAST(mrr * 12 AS {MONEY}) AS arr, customers AS active_customers,
               CAST(mrr AS DOUBLE) / customers AS arpu, churned::DOUBLE / n AS churn_rate,
               1.0::DOUBLE - churned::DOUBLE / n AS retention_rate,
               CAST(mrr - lag(mrr) OVER (ORDER BY month) AS {MONEY}) AS mrr_change,
               (CAST(mrr AS DOUBLE) / customers) / nullif(churned::DOUBLE / n, 0) AS ltv_proxy
           FROM (SELECT date_key AS month, CAST(sum(monthly_revenue) AS {MONEY}) AS mrr,
                     count(DISTINCT customer_key) AS customers,
                     CAST(sum(churn_flag) AS BIGINT) AS churned, count(*) AS n
                 FROM fact GROUP BY date_key)""",
    ),
    "drill": (
        ["fact", "customers"],
        f"""SELECT f.date_key AS month, f.region, f.segment, f.plan_name, c.channel,
               CAST(sum(f.monthly_revenue) AS {MONEY}) AS mrr,
               count(DISTINCT f.customer_key) AS active_customers,
               CAST(sum(f.churn_flag) AS BIGINT) AS churned_customers,
               CAST(sum(f.monthly_revenue) AS DOUBLE) / count(DISTINCT f.customer_key) AS arpu,
               CAST(sum(f.churn_flag) AS DOUBLE) / count(*) AS churn_rate,
               CAST(sum(f.usage_score) AS DOUBLE) / count(*) AS avg_usage_score,
               CAST(sum(f.support_tickets) AS BIGINT) AS total_support_tickets,
               CAST(sum(f.failed_payments) AS BIGINT) AS total_failed_payments
           FROM fact f JOIN customers c ON c.customer_key = f.customer_key GROUP BY ALL""",
    ),
    "cohorts": (
        ["fact"],
        """SELECT cohort_month, period_num, retained_customers,
               first_value(retained_customers) OVER w AS cohort_size,
               retained_customers::DOUBLE / first_value(retained_customers) OVER w AS retention_rate
           FROM (SELECT cohort_month,
                     CAST(date_diff('month', cohort_month, date_key) AS INT) AS period_num,
                     count(DISTINCT customer_key) AS retained_customers
                 FROM fact JOIN (SELECT customer_key, min(date_key) AS cohort_month
                                 FROM fact GROUP BY customer_key) USING (customer_key)
                 WHERE churn_flag = 0 GROUP BY ALL)
           WINDOW w AS (PARTITION BY cohort_month ORDER BY period_num)""",
    ),
    "at_risk": (
        ["fact", "customers", "shown"],
        """SELECT customer_id, c.region, c.segment, plan_name, channel, date_key AS last_active_month,
               churn_risk_score, usage_score, support_tickets, failed_payments,
               CASE WHEN churn_risk_score >= 70 THEN 'HIGH' WHEN churn_risk_score >= 40 THEN 'MEDIUM'
                    ELSE 'LOW' END AS risk_tier, monthly_revenue
           FROM fact JOIN customers c USING (customer_key)
           WHERE churn_flag = 0 AND date_key = (FROM shown)""",
    ),
    "region_month": (
        ["fact"],
        f"""SELECT *, lag(mrr) OVER w AS prev_mrr, lag(churn_rate) OVER w AS prev_churn_rate
           FROM (SELECT date_key, region, CAST(sum(monthly_revenue) AS {MONEY}) AS mrr,
                     CAST(sum(churn_flag) AS DOUBLE) / count(*) AS churn_rate,
                     CAST(sum(churn_risk_score) AS DOUBLE) / count(*) AS avg_risk_score,
                     CAST(sum(failed_payments) AS DOUBLE) / count(*) AS failed_payment_rate
                 FROM fact GROUP BY date_key, region)
           WINDOW w AS (PARTITION BY region ORDER BY date_key)""",
    ),
    # Percent change in whole hundredths: round half away from zero on integer cents.
    "alerts": (
        ["region_month"],
        """SELECT date_key, region, mrr, churn_rate, prev_mrr, prev_churn_rate,
               CAST(sign(delta) * ((abs(delta) * 20000 + base) // nullif(2 * base, 0)) AS DOUBLE) / 100
                   AS mrr_change_pct,
               round(round((churn_rate - prev_churn_rate) / nullif(prev_churn_rate, 0) * 100, 10), 2)
                   AS churn_change_pct,
               churn_rate > 0.08::DOUBLE AS churn_spike_flag,
               base > 0 AND delta * 20 < -base AS revenue_drop_flag
           FROM (SELECT *, CAST((mrr - prev_mrr) * 100 AS HUGEINT) AS delta,
                     CAST(prev_mrr * 100 AS HUGEINT) AS base
                 FROM region_month WHERE prev_mrr IS NOT NULL)""",
    ),
    "mix": (
        ["fact"],
        f"""SELECT date_key AS month, segment, plan_name AS plan_type, region,
               CAST(sum(monthly_revenue) AS {MONEY}) AS mrr, count(DISTINCT customer_key) AS customers
           FROM fact GROUP BY ALL""",
    ),
    "mix_latest": (["mix", "shown"], "SELECT * FROM mix WHERE month = (FROM shown)"),
    "drill_latest": (["drill", "shown"], "SELECT * FROM drill WHERE month = (FROM shown)"),
    "feed": (
        ["alerts"],
        f"""SELECT date_key, strftime(date_key, '%b %y') AS month_label, region,
               if(churn_spike_flag, 'CHURN_SPIKE', 'REVENUE_DROP') AS alert_type,
               if(churn_spike_flag, 'Churn rate', 'MRR change') AS label,
               if(churn_spike_flag, {_half_up("churn_rate * 100", 2)}, mrr_change_pct) AS value,
               '%' AS unit
           FROM alerts WHERE churn_spike_flag OR revenue_drop_flag
           ORDER BY date_key DESC, region LIMIT 12""",
    ),
    "top_risk": (
        ["at_risk"],
        """SELECT customer_id, region, plan_name, CAST(floor(churn_risk_score::DOUBLE + 0.5) AS INT) AS risk,
               risk_tier, failed_payments, support_tickets, usage_score, monthly_revenue
           FROM at_risk ORDER BY churn_risk_score DESC, customer_id LIMIT 15""",
    ),
    "metrics": (
        ["region_month"],
        """SELECT date_key, region, 'monthly_churn_rate' AS metric_name, churn_rate AS metric_value
               FROM region_month
           UNION ALL SELECT date_key, region, 'mrr_drop_pct',
               CAST(mrr - prev_mrr AS DOUBLE) / nullif(CAST(prev_mrr AS DOUBLE), 0)
               FROM region_month WHERE prev_mrr IS NOT NULL
           UNION ALL SELECT date_key, region, 'avg_risk_score', avg_risk_score FROM region_month
           UNION ALL SELECT date_key, region, 'failed_payment_rate', failed_payment_rate
               FROM region_month""",
    ),
    "judged": (
        ["metrics", "thresholds"],
        """SELECT date_key, region, metric_name, metric_value,
               CASE WHEN if(direction = 'ABOVE', metric_value >= critical_threshold::DOUBLE,
                            metric_value <= critical_threshold::DOUBLE) THEN 'CRITICAL'
                    WHEN if(direction = 'ABOVE', metric_value >= warning_threshold::DOUBLE,
                            metric_value <= warning_threshold::DOUBLE) THEN 'WARNING'
                    ELSE 'OK' END AS severity
           FROM metrics JOIN thresholds USING (metric_name)""",
    ),
    # The CSV loads: all but the newest month, then that month.
    "runs": (
        ["stg"],
        """SELECT log_id, triggered_by, 'fact_subscriptions' AS source_table, rows_loaded, rows_rejected,
               if(rows_rejected > 0, 'PARTIAL', 'SUCCESS') AS status, CAST(NULL AS VARCHAR) AS error_message
           FROM (SELECT 1 AS log_id, 'manual:close' AS triggered_by, count(*) FILTER (month < newest) AS rows_loaded,
                     count(*) FILTER (month = newest) AS rows_rejected
                 FROM stg, (SELECT max(month) AS newest FROM stg)
                 UNION ALL
                 SELECT 2, 'manual:reload', count(*) FILTER (month = newest), 0
                 FROM stg, (SELECT max(month) AS newest FROM stg))""",
    ),
    # All months but the newest, which a lost load leaves as they were, and all of them.
    "told": (
        ["stg"],
        """SELECT phase, count(*) AS rows, count(DISTINCT customer_key) AS customers,
               CAST(sum(monthly_revenue) AS DECIMAL(38,2)) AS revenue, count(DISTINCT month) AS months
           FROM stg JOIN (SELECT max(month) AS until, 'after the rerun' AS phase FROM stg UNION ALL
               SELECT max(month), 'after the lost load' FROM stg WHERE month < (SELECT max(month) FROM stg)) ON month <= until
           GROUP BY phase""",
    ),
    "calendar": (
        ["stg"],
        """SELECT CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS date_key
           FROM stg""",
    ),
    "shown_cohorts": (
        ["cohorts"],
        """SELECT cohort_month FROM (
               SELECT cohort_month, row_number() OVER (ORDER BY cohort_month) AS place, count(*) OVER () AS n
               FROM (SELECT DISTINCT cohort_month FROM cohorts))
           WHERE n <= 6 OR place % 2 = 1 ORDER BY cohort_month DESC LIMIT 6""",
    ),
}


def _heatmap():
    pct = "max(CAST(floor(retention_rate * 100.0::DOUBLE + 0.5) AS INT)) FILTER (period_num = {p})"
    cells = ", ".join(f"{pct.format(p=p)} AS m{p}" for p in range(12))
    bands = ", ".join(
        f"CASE WHEN m{p} IS NULL THEN 'none' WHEN m{p} >= 90 THEN '90+' WHEN m{p} >= 80 THEN '80-89'"
        f" WHEN m{p} >= 70 THEN '70-79' WHEN m{p} >= 60 THEN '60-69' ELSE '<60' END AS band{p}"
        for p in range(12)
    )
    return f"""SELECT *, {bands} FROM (
        SELECT cohort_month, strftime(cohort_month, '%b %y') AS cohort_label, {cells}
        FROM cohorts JOIN shown_cohorts USING (cohort_month) GROUP BY cohort_month)"""


def _drilldown_kpis(where="TRUE"):
    return f"""SELECT CAST(coalesce(sum(mrr), 0) AS {MONEY}) AS mrr,
        CAST(coalesce(sum(active_customers), 0) AS BIGINT) AS customer_months,
        {_half_up("coalesce(avg(churn_rate), 0)", 6)} AS mean_churn_rate,
        {_half_up("coalesce(avg(avg_usage_score), 0)", 6)} AS mean_usage
        FROM drill WHERE {where}"""


def _counts(**tables):
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CAST({count} AS BIGINT) AS row_count" for name, count in tables.items()
    )


def _count(source):
    return f"(SELECT count(*) FROM {source})"


_CALENDAR = [f"DATE '{month}'" for month in (S.CALENDAR_FIRST, S.CALENDAR_LAST)]
_IN_CALENDAR = f"date_key = date_trunc('month', date_key) AND date_key BETWEEN {_CALENDAR[0]} AND {_CALENDAR[1]}"

_REGION_MIX = """SELECT region, if(region = 'North America', 'N. America', region) AS region_label,
    CAST(sum(mrr) AS DECIMAL(28,2)) AS mrr FROM {source} GROUP BY region"""

# query -> (CTEs it reads, body)
BODIES = {
    "mrr_monthly": (["mrr"], "SELECT * FROM mrr"),
    "revenue_drilldown": (["drill"], "SELECT * FROM drill"),
    "cohort_retention": (["cohorts"], "SELECT * FROM cohorts"),
    "accounts_at_risk": (["at_risk"], "SELECT * FROM at_risk"),
    "alerts": (["alerts"], "SELECT * FROM alerts"),
    # The drop is a percentage, and is compared with the stored limits as they are.
    "active_alerts": (
        ["alerts", "thresholds", "shown"],
        """SELECT date_key, region, alert_type, value AS metric_value,
               CASE WHEN if(direction = 'ABOVE', value >= critical_threshold::DOUBLE,
                            value <= critical_threshold::DOUBLE) THEN 'CRITICAL'
                    WHEN if(direction = 'ABOVE', value >= warning_threshold::DOUBLE,
                            value <= warning_threshold::DOUBLE) THEN 'WARNING' ELSE 'OK' END AS severity
           FROM (SELECT date_key, region, 'CHURN_SPIKE' AS alert_type, 'monthly_churn_rate' AS metric_name,
                     churn_rate AS value FROM alerts WHERE churn_spike_flag
                 UNION ALL SELECT date_key, region, 'REVENUE_DROP', 'mrr_drop_pct', mrr_change_pct
                 FROM alerts WHERE revenue_drop_flag)
           JOIN thresholds USING (metric_name) WHERE date_key = (FROM shown)""",
    ),
    "revenue_mix": (["mix"], "SELECT * FROM mix"),
    "health_signals": (
        ["fact"],
        """SELECT date_key AS month, region, segment,
               CAST(sum(usage_score) AS DOUBLE) / count(*) AS avg_usage_score,
               CAST(sum(support_tickets) AS BIGINT) AS total_tickets,
               CAST(sum(failed_payments) AS BIGINT) AS total_failed_payments,
               CAST(sum(churn_risk_score) AS DOUBLE) / count(*) AS avg_risk_score,
               count(DISTINCT customer_key) FILTER (churn_risk_score >= 70) AS high_risk_count
           FROM fact GROUP BY ALL""",
    ),
    "stg_subscriptions": (["stg"], "SELECT * EXCLUDE (customer_key) FROM stg"),
    "staging_from_csv": (["stg"], "SELECT * EXCLUDE (customer_key) FROM stg"),
    "anon_customer_id": (["account"], "SELECT c_custkey, customer_id FROM account"),
    "risk_score": (
        ["stg"],
        f"""SELECT customer_id, month, failed_payments, support_tickets, usage_score,
            {_score()} AS churn_risk_score FROM stg""",
    ),
    "plan_usage": (
        ["plans", "fact"],
        f"""SELECT plan_key, plan_name, tier_rank, CAST(base_price_usd AS DECIMAL(10,2)) AS base_price_usd,
               {_count("fact f WHERE f.plan_key = plans.plan_key")} AS account_months FROM plans""",
    ),
    "region_usage": (
        ["fact"],
        f"""SELECT region_key, region_name, geo_cluster,
               {_count("fact WHERE region = region_name")} AS account_months
           FROM (VALUES (1, 'North America', 'AMER'), (2, 'EMEA', 'EMEA'), (3, 'APAC', 'APAC'),
               (4, 'LATAM', 'LATAM')) AS t(region_key, region_name, geo_cluster)""",
    ),
    "threshold_hits": (
        ["thresholds", "judged"],
        f"""SELECT *, {_count("judged j WHERE j.metric_name = thresholds.metric_name AND severity <> 'OK'")}
               AS values_reached FROM thresholds""",
    ),
    "dim_date": (
        ["calendar"],
        """SELECT date_key, CAST(year(date_key) AS INT) AS year, CAST(quarter(date_key) AS INT) AS quarter,
               CAST(month(date_key) AS INT) AS month_num, monthname(date_key) AS month_name,
               CAST(weekofyear(date_key) AS INT) AS week_num, CAST(isodow(date_key) AS INT) AS day_of_week,
               TRUE AS is_month_start, CAST(year(date_key) AS INT) AS fiscal_year,
               CAST(quarter(date_key) AS INT) AS fiscal_quarter FROM calendar""",
    ),
    "dim_customer": (["customers"], "SELECT * FROM customers"),
    "fact_subscriptions": (["fact"], "SELECT * EXCLUDE (plan_name) FROM fact"),
    "fact_orphans": (
        ["fact", "customers", "plans"],
        _counts(
            customer_key=_count("fact f WHERE NOT EXISTS (FROM customers c WHERE c.customer_key = f.customer_key)"),
            plan_key=_count("fact WHERE plan_key NOT IN (SELECT plan_key FROM plans)"),
            date_key=_count(f"fact WHERE NOT ({_IN_CALENDAR})"),
        ),
    ),
    "constraint_violations": (
        ["fact", "customers", "runs", "thresholds"],
        _counts(
            fact_domains=_count(
                "fact WHERE NOT coalesce(churn_flag IN (0, 1) AND active_flag IN (0, 1) AND usage_score BETWEEN 0 AND 1"
                " AND len(list_filter([customer_key::VARCHAR, date_key::VARCHAR, plan_key::VARCHAR,"
                " monthly_revenue::VARCHAR, region, segment, support_tickets::VARCHAR, failed_payments::VARCHAR],"
                " lambda x: x IS NULL)) = 0, FALSE)"
            ),
            fact_account_month=_count("(FROM fact SELECT customer_key GROUP BY customer_key, date_key HAVING count(*) > 1)"),
            customer_id=_count("(FROM customers SELECT customer_id GROUP BY customer_id HAVING count(*) > 1)"),
            log_status=_count("runs WHERE status NOT IN ('SUCCESS', 'FAILED', 'PARTIAL')"),
            log_id="(SELECT count(*) - count(DISTINCT log_id) FROM runs)",
            threshold_direction=_count("thresholds WHERE direction NOT IN ('ABOVE', 'BELOW')"),
            metric_name="(SELECT count(*) - count(DISTINCT metric_name) FROM thresholds)",
            refused_rows="(SELECT sum(rows_rejected) FROM runs)",
        )
        .replace("AS table_name", "AS constraint_name")
        .replace("AS row_count", "AS violations"),
    ),
    "fact_rows_json": (["fact"], """SELECT '{"fact_rows":' || count(*) || '}' AS result FROM fact"""),
    "load_rejects": (
        ["runs"],
        "SELECT 'month_outside_calendar' AS reject_reason, rows_rejected FROM runs WHERE rows_rejected > 0",
    ),
    "load_audit": (
        ["stg"],
        """SELECT 1 AS log_id, 'scheduler' AS triggered_by, 'fact_subscriptions' AS source_table,
               count(*) AS rows_loaded, 0 AS rows_rejected, 'SUCCESS' AS status,
               CAST(NULL AS VARCHAR) AS error_message FROM stg""",
    ),
    "load_rerun_counts": (
        ["customers", "fact", "runs"],
        _counts(
            dim_customer=_count("customers"),
            fact_subscriptions=_count("fact"),
            refresh_log=_count("runs"),
            stg_rejects="(SELECT sum(rows_rejected) FROM runs)",
        ),
    ),
    "fact_by_natural_id": (
        ["fact", "customers"],
        """SELECT f.* EXCLUDE (customer_key, plan_key), c.customer_id, c.channel
           FROM fact f JOIN customers c ON c.customer_key = f.customer_key""",
    ),
    "refresh_log_recent": (
        ["runs"],
        """SELECT *, if(status = 'SUCCESS', format('{:,}', rows_loaded) || ' rows', coalesce(error_message, status)) AS detail
           FROM runs ORDER BY log_id DESC LIMIT 10""",
    ),
    "refresh_log_latest": (
        ["runs"],
        """SELECT triggered_by, source_table, rows_loaded, status
           FROM runs ORDER BY log_id DESC LIMIT 1""",
    ),
    # The close was long before the reload.
    "refresh_log_retained": (
        ["runs"],
        f"""SELECT * FROM runs WHERE {RELOAD_DAYS} * (log_id - (SELECT max(log_id) FROM runs)) >= -{S.LOG_RETENTION_DAYS}""",
    ),
    "load_after_failure": (
        ["told"],
        """SELECT 'fact_subscriptions' AS table_name, rows AS row_count, revenue, months, phase FROM told
           UNION ALL SELECT 'dim_customer', customers, revenue, months, phase FROM told""",
    ),
    "load_after_failure_log": (
        ["stg"],
        """SELECT log_id, triggered_by, 'fact_subscriptions' AS source_table, CAST(rows_loaded AS BIGINT) AS rows_loaded,
               CAST(0 AS BIGINT) AS rows_rejected, status, error_message
           FROM (SELECT 1 AS log_id, 'nightly' AS triggered_by, count(*) FILTER (month < newest) AS rows_loaded,
                     'SUCCESS' AS status, CAST(NULL AS VARCHAR) AS error_message FROM stg, (SELECT max(month) AS newest FROM stg)
                 UNION ALL SELECT 2, 'nightly', 0, 'FAILED', 'driver lost'
                 UNION ALL SELECT 3, 'rerun', count(*) FILTER (month = newest), 'SUCCESS', NULL
                 FROM stg, (SELECT max(month) AS newest FROM stg))""",
    ),
    "fact_after_corrections": (["corrected"], "SELECT * EXCLUDE (plan_name) FROM corrected"),
    "mrr_after_corrections": (["mrr"], "SELECT * FROM mrr"),
    "corrections_log": (
        ["fact", "corrected"],
        """SELECT 1 AS log_id, 'nightly' AS triggered_by, 'fact_subscriptions' AS source_table, count(*) AS rows_loaded,
               CAST(0 AS BIGINT) AS rows_rejected, 'SUCCESS' AS status, CAST(NULL AS VARCHAR) AS error_message FROM fact
           UNION ALL SELECT 2, 'correction', 'fact_subscriptions', count(*), 0, 'SUCCESS', NULL
           FROM fact JOIN corrected c USING (customer_key, date_key) WHERE fact.monthly_revenue <> c.monthly_revenue""",
    ),
    "line_rejects": (
        ["stg"],
        """SELECT reason AS reject_reason, CAST(count(*) AS BIGINT) AS rows_rejected,
               CAST(count(*) FILTER (lane < 4) AS BIGINT) AS with_text
           FROM (SELECT customer_key % 20 AS lane,
                     ['surplus_fields', 'missing_fields', 'broken_quote', 'unparsable_value', 'unknown_plan',
                      'usage_out_of_range', 'flag_not_0_or_1', 'missing_value'][CAST(customer_key % 20 AS INT) + 1] AS reason
                 FROM stg WHERE customer_key % 20 < 8) GROUP BY reason""",
    ),
    "unparsed_revenue": (
        ["stg"],
        """SELECT customer_id, replace(CAST(monthly_revenue AS VARCHAR), '.', 'o') AS text
           FROM stg WHERE customer_key % 20 = 3""",
    ),
    "table_counts": (
        ["customers", "plans", "fact", "stg"],
        _counts(
            dim_customer=_count("customers"),
            dim_plan=_count("plans"),
            dim_date=f"(SELECT date_diff('month', {_CALENDAR[0]}, {_CALENDAR[1]}) + 1)",
            fact_subscriptions=_count("fact"),
            stg_subscriptions=_count("stg"),
            refresh_log=1,
        ),
    ),
    "published_alerts": (["alerts"], "SELECT * FROM alerts"),
    "latest_mrr_row": (["mrr"], "SELECT month, mrr FROM mrr ORDER BY month DESC LIMIT 1"),
    "overview_kpis": (
        ["mrr", "at_risk"],
        f"""SELECT month, mrr, arr, active_customers, churn_rate, retention_rate, arpu, ltv_proxy,
               CAST(mrr - lag(mrr) OVER w AS DOUBLE) / nullif(CAST(lag(mrr) OVER w AS DOUBLE), 0) * 100.0::DOUBLE
                   AS mrr_change_pct,
               CAST(active_customers - lag(active_customers) OVER w AS DOUBLE)
                   / nullif(CAST(lag(active_customers) OVER w AS DOUBLE), 0) * 100.0::DOUBLE
                   AS customers_change_pct,
               (retention_rate - lag(retention_rate) OVER w) * 100.0::DOUBLE AS retention_change_pp,
               {_count("at_risk WHERE churn_risk_score >= 70")} AS high_risk_accounts
           FROM mrr WINDOW w AS (ORDER BY month) ORDER BY month DESC LIMIT 1""",
    ),
    "mrr_churn_trend": (
        ["mrr"],
        f"""SELECT month, strftime(month, '%b %y') AS month_label, mrr, churn_pct,
               {_churn_band("churn_pct")} AS band
           FROM (SELECT *, churn_rate * 100.0::DOUBLE AS churn_pct FROM mrr)""",
    ),
    "plan_mix_latest": (
        ["mix_latest"],
        f"""SELECT plan_type, CAST(sum(mrr) AS {MONEY}) AS mrr,
               {_percent("sum(mrr)", "(SELECT sum(mrr) FROM mix_latest)")} AS share_pct
           FROM mix_latest GROUP BY plan_type""",
    ),
    "region_mix_latest": (["mix_latest"], _REGION_MIX.format(source="mix_latest")),
    "region_revenue_alltime": (["mix"], _REGION_MIX.format(source="mix")),
    "segment_stack": (
        ["drill_latest"],
        "SELECT region, "
        + ", ".join(
            f"CAST(coalesce(sum(mrr) FILTER (segment = '{s}'), 0) AS {MONEY}) AS {name}"
            for s, name in [
                ("SMB", "smb_mrr"),
                ("Mid-Market", "mid_market_mrr"),
                ("Enterprise", "enterprise_mrr"),
            ]
        )
        + " FROM drill_latest GROUP BY region",
    ),
    "churn_by_region": (
        ["drill_latest"],
        f"""SELECT region, churn_pct, {_churn_band("churn_pct")} AS band
           FROM (SELECT region, {_half_up("avg(churn_rate) * 100.0::DOUBLE", 2)} AS churn_pct
                 FROM drill_latest GROUP BY region)""",
    ),
    "revenue_impact_top8": (
        ["drill"],
        f"""SELECT plan_name, channel, CAST(sum(mrr) AS {MONEY}) AS mrr,
               CAST(sum(active_customers) AS BIGINT) AS customer_months,
               {_half_up("avg(churn_rate) * 100.0::DOUBLE", 1)} AS mean_churn_pct,
               {_half_up("avg(avg_usage_score)", 2)} AS mean_usage,
               CAST(sum(mrr) AS DOUBLE) / CAST(sum(active_customers) AS DOUBLE) AS arpu
           FROM drill GROUP BY plan_name, channel ORDER BY sum(mrr) DESC, plan_name, channel LIMIT 8""",
    ),
    "drilldown_kpis_all": (["drill"], _drilldown_kpis()),
    "drilldown_kpis_emea_growth": (
        ["drill"],
        _drilldown_kpis("region = 'EMEA' AND plan_name = 'Growth'"),
    ),
    "drilldown_distinct_customers": (
        ["fact", "customers"],
        """SELECT plan_name, channel, CAST(count(DISTINCT fact.customer_key) AS BIGINT) AS customers
           FROM fact JOIN customers USING (customer_key)
           WHERE date_key BETWEEN DATE '1998-01-01' AND DATE '1999-12-01' GROUP BY plan_name, channel""",
    ),
    "distinct_customers_emea_growth": (
        ["fact"],
        """SELECT CAST(count(DISTINCT customer_key) AS BIGINT) AS customers FROM fact
           WHERE region = 'EMEA' AND plan_name = 'Growth'""",
    ),
    "distinct_customers_by_region": (
        ["fact"],
        "SELECT region, CAST(count(DISTINCT customer_key) AS BIGINT) AS customers FROM fact GROUP BY region",
    ),
    "risk_tier_counts": (
        ["at_risk"],
        f"""SELECT risk_tier, {_count("at_risk a WHERE a.risk_tier = t.risk_tier")} AS accounts
           FROM (VALUES ('HIGH'), ('MEDIUM'), ('LOW')) AS t(risk_tier)""",
    ),
    "risk_drivers": (
        ["at_risk"],
        f"""SELECT {_percent("count(*) FILTER (usage_score < 0.3)", "greatest(count(*), 1)")} AS low_usage_pct,
               {_percent("count(*) FILTER (failed_payments > 0)", "greatest(count(*), 1)")} AS failed_payment_pct,
               {_percent("count(*) FILTER (support_tickets >= 4)", "greatest(count(*), 1)")} AS ticket_pct
           FROM at_risk WHERE risk_tier = 'HIGH'""",
    ),
    "risk_by_segment": (
        ["at_risk"],
        f"""SELECT segment, count(*) AS accounts,
               {_percent("count(*)", _count("at_risk WHERE risk_tier = 'HIGH'"))} AS share_pct
           FROM at_risk WHERE risk_tier = 'HIGH' GROUP BY segment""",
    ),
    "risk_by_region": (
        ["at_risk"],
        """SELECT region, count(*) FILTER (risk_tier = 'HIGH') AS high_accounts,
               count(*) FILTER (risk_tier = 'MEDIUM') AS medium_accounts FROM at_risk GROUP BY region""",
    ),
    "top_risk_accounts": (["top_risk"], "SELECT * FROM top_risk"),
    "cohort_heatmap": (["cohorts", "shown_cohorts"], _heatmap()),
    "alert_feed": (["feed"], "SELECT * FROM feed"),
    "alert_feed_severity": (
        ["feed"],
        """SELECT date_key, month_label, region, alert_type, replace(alert_type, '_', ' ') AS title, label,
               value, limit_pct AS threshold_pct,
               CASE WHEN abs(value) < abs(limit_pct) THEN 'RESOLVED'
                    WHEN abs(value) >= critical_pct THEN 'CRITICAL' ELSE 'WARNING' END AS severity
           FROM (SELECT *, if(alert_type = 'CHURN_SPIKE', 8.0::DOUBLE, -5.0::DOUBLE) AS limit_pct,
                     if(alert_type = 'CHURN_SPIKE', 8.0::DOUBLE * 1.3::DOUBLE, 5.0::DOUBLE * 1.5::DOUBLE)
                         AS critical_pct
                 FROM feed)""",
    ),
    "rls_fact_region_totals": (
        ["fact"],
        f"""SELECT date_key, region, CAST(sum(monthly_revenue) AS {MONEY}) AS mrr,
               count(*) AS account_months, CAST(sum(churn_flag) AS BIGINT) AS churned_customers
           FROM fact WHERE region = '{ANALYST_REGION}' GROUP BY date_key, region""",
    ),
    "rls_mrr_monthly": (["mrr"], "SELECT * FROM mrr"),
    "top_risk_accounts_emea": (["top_risk"], f"SELECT * FROM top_risk WHERE region = '{ANALYST_REGION}'"),
    "mrr_latest_emea": (
        ["mix_latest"],
        f"""SELECT CAST(coalesce(sum(mrr), 0) AS {MONEY}) AS mrr
           FROM mix_latest WHERE region = '{ANALYST_REGION}'""",
    ),
    "threshold_alerts": (["judged"], "SELECT * FROM judged"),
}


def _closure(names):
    found = set()
    todo = list(names)
    while todo:
        name = todo.pop()
        if name not in found:
            found.add(name)
            todo.extend(CTES[name][0])
    return [name for name in CTES if name in found]


def statement(query: str) -> str:
    reads, body = BODIES[query]
    sql = {name: CTES[name][1] for name in _closure(reads)}
    if query == "rls_mrr_monthly":
        sql["fact"] += f" WHERE region = '{ANALYST_REGION}'"
    if query == "mrr_after_corrections":
        reads = ["corrected"]
        sql = {name: CTES[name][1] for name in _closure(reads)} | {"mrr": sql["mrr"].replace("FROM fact", "FROM corrected")}
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in sql.items())
    return f"WITH {ctes}\n{body}"


def statements() -> dict[str, str]:
    return {query: statement(query) for query in BODIES}
