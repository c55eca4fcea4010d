"""Declared table schemas and the fixed rows and limits that belong to them."""

from decimal import Decimal

from pyspark.sql import types as T

# Revenue of one account and month. Ten digits before the point would do for an
# ordinary account, but not for one that holds a third of a very large input.
REVENUE = T.DecimalType(18, 2)
# Money sums: a sum of decimal(18,2) is decimal(28,2) in Spark, so this never narrows.
MONEY = T.DecimalType(28, 2)
SCORE = T.DecimalType(5, 2)

STAGING = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("month", T.DateType()),
        T.StructField("region", T.StringType()),
        T.StructField("plan_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("monthly_revenue", REVENUE),
        T.StructField("churn_flag", T.IntegerType()),
        T.StructField("active_flag", T.IntegerType()),
        T.StructField("usage_score", T.DecimalType(4, 3)),
        T.StructField("support_tickets", T.IntegerType()),
        T.StructField("failed_payments", T.IntegerType()),
        T.StructField("cohort_month", T.DateType()),
    ]
)

FACT = T.StructType(
    [
        T.StructField("sub_key", T.LongType()),
        T.StructField("customer_key", T.LongType()),
        T.StructField("date_key", T.DateType()),
        T.StructField("plan_key", T.IntegerType()),
        T.StructField("monthly_revenue", REVENUE),
        T.StructField("churn_flag", T.IntegerType()),
        T.StructField("active_flag", T.IntegerType()),
        T.StructField("usage_score", T.DecimalType(4, 3)),
        T.StructField("support_tickets", T.IntegerType()),
        T.StructField("failed_payments", T.IntegerType()),
        T.StructField("churn_risk_score", SCORE),
        T.StructField("region", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("loaded_at", T.TimestampType()),
    ]
)

CUSTOMER = T.StructType(
    [
        T.StructField("customer_key", T.LongType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("cohort_month", T.DateType()),
        T.StructField("region", T.StringType()),
        T.StructField("plan_type", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("segment", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

REFRESH_LOG = T.StructType(
    [
        T.StructField("log_id", T.LongType()),
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("triggered_by", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

# A refused row: why, how often, and the row itself as JSON.
REJECTS = T.StructType(
    [
        T.StructField("load_id", T.LongType()),
        T.StructField("reject_reason", T.StringType()),
        T.StructField("copies", T.LongType()),
        T.StructField("row", T.StringType()),
    ]
)

# What loads did, so that later ones need not ask the fact: a row when a load
# begins, and one for each month it wrote (or one without a month) when it ends.
LOADS = T.StructType(
    [
        T.StructField("load_id", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("date_key", T.DateType()),
        T.StructField("rows", T.LongType()),
        T.StructField("top_sub_key", T.LongType()),
        T.StructField("top_customer_key", T.LongType()),
    ]
)

# ---- Fixed values: seed rows and domains ------------------------------------

PLAN_COLUMNS = "plan_key INT, plan_name STRING, tier_rank INT, base_price_usd DECIMAL(10,2)"
PLAN_ROWS = [
    (1, "Starter", 1, Decimal("299.00")),
    (2, "Growth", 2, Decimal("1299.00")),
    (3, "Enterprise", 3, Decimal("4999.00")),
    (4, "Enterprise Plus", 4, Decimal("14999.00")),
]

REGION_COLUMNS = "region_key INT, region_name STRING, geo_cluster STRING"
REGION_ROWS = [
    (1, "North America", "AMER"),
    (2, "EMEA", "EMEA"),
    (3, "APAC", "APAC"),
    (4, "LATAM", "LATAM"),
]

THRESHOLD_COLUMNS = (
    "threshold_id INT, metric_name STRING, warning_threshold DECIMAL(18,6), "
    "critical_threshold DECIMAL(18,6), direction STRING, enabled BOOLEAN"
)
THRESHOLD_ROWS = [
    (1, "monthly_churn_rate", Decimal("0.06"), Decimal("0.10"), "ABOVE", True),
    (2, "mrr_drop_pct", Decimal("-0.05"), Decimal("-0.10"), "BELOW", True),
    (3, "avg_risk_score", Decimal("50"), Decimal("70"), "ABOVE", True),
    (4, "failed_payment_rate", Decimal("0.08"), Decimal("0.15"), "ABOVE", True),
]

POLICY_COLUMNS = "db_user STRING, region STRING"
POLICY_ROWS = [
    ("bi_analyst_na", "North America"),
    ("bi_analyst_emea", "EMEA"),
]

SEGMENTS = ["SMB", "Mid-Market", "Enterprise"]

# Months a new warehouse accepts; more by argument, never by what a batch holds.
CALENDAR_FIRST, CALENDAR_LAST = "1990-01-01", "2039-12-01"

HIGH_RISK = 70
MEDIUM_RISK = 40
CHURN_SPIKE_RATE = 0.08
REVENUE_DROP_SHARE = -0.05
TOP_RISK_ACCOUNTS = 15
TOP_IMPACT_ROWS = 8
ALERT_FEED_ROWS = 12
RECENT_LOG_ROWS = 10
HEATMAP_PERIODS = 12
HEATMAP_COHORTS = 6
LOG_RETENTION_DAYS = 90
# ---- end of fixed values ----------------------------------------------------
