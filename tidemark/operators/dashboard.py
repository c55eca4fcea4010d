"""Dashboard aggregations over the marts.

Inputs are mart rows, whose number is bounded by months times the plan,
region, segment and channel lists, or the active accounts of one month.
Windows without a partition key appear only after such rows were
aggregated again.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import (
    churn_band,
    half_up,
    half_up_int,
    mean_rate,
    money,
    month_label,
    percent_of,
    ratio,
    region_label,
    retention_band,
)

SLICERS = ("region", "plan_name", "segment", "channel")


def total_over(column):
    """Sum over the whole result, for shares of a handful of group rows."""
    return F.sum(column).over(W.partitionBy())


# ---- overview ---------------------------------------------------------------


def overview_kpis(mrr: DataFrame, at_risk: DataFrame) -> DataFrame:
    """The headline row: latest month, change against the month before, high-risk count."""
    before = W.orderBy("month")

    def change_pct(column):
        prev = F.lag(column).over(before)
        return ratio(F.col(column) - prev, prev) * F.lit(100.0)

    high_risk = at_risk.select(F.count_if(F.col("churn_risk_score") >= S.HIGH_RISK)).scalar()
    return (
        mrr.withColumns(
            {
                "mrr_change_pct": change_pct("mrr"),
                "customers_change_pct": change_pct("active_customers"),
                "retention_change_pp": (
                    F.col("retention_rate") - F.lag("retention_rate").over(before)
                )
                * F.lit(100.0),
            }
        )
        .orderBy(F.desc("month"))
        .limit(1)
        .select(
            "month",
            "mrr",
            "arr",
            "active_customers",
            "churn_rate",
            "retention_rate",
            "arpu",
            "ltv_proxy",
            "mrr_change_pct",
            "customers_change_pct",
            "retention_change_pp",
            high_risk.alias("high_risk_accounts"),
        )
    )


def mrr_churn_trend(mrr: DataFrame) -> DataFrame:
    churn_pct = F.col("churn_rate") * F.lit(100.0)
    return mrr.select(
        "month",
        month_label("month").alias("month_label"),
        "mrr",
        churn_pct.alias("churn_pct"),
        churn_band(churn_pct).alias("band"),
    )


def plan_mix(mix: DataFrame) -> DataFrame:
    """Revenue share by plan, integer percent."""
    by_plan = mix.groupBy("plan_type").agg(money(F.sum("mrr")).alias("mrr"))
    return by_plan.select(
        "plan_type", "mrr", percent_of(F.col("mrr"), total_over("mrr")).alias("share_pct")
    ).orderBy(F.desc("mrr"), "plan_type")


def region_mix(mix: DataFrame) -> DataFrame:
    return (
        mix.groupBy("region")
        .agg(money(F.sum("mrr")).alias("mrr"))
        .select("region", region_label().alias("region_label"), "mrr")
        .orderBy(F.desc("mrr"), "region")
    )


def latest_mrr_row(mrr: DataFrame) -> DataFrame:
    return mrr.select("month", "mrr").orderBy(F.desc("month")).limit(1)


# ---- drilldown --------------------------------------------------------------


def segment_stack(drill: DataFrame) -> DataFrame:
    """Revenue by region and segment, one column per segment, zero for empty cells."""
    stacked = drill.groupBy("region").pivot("segment", S.SEGMENTS).agg(F.sum("mrr"))
    names = {"SMB": "smb_mrr", "Mid-Market": "mid_market_mrr", "Enterprise": "enterprise_mrr"}
    zero = F.lit(0).cast(S.MONEY)
    return stacked.select(
        "region",
        *[F.coalesce(money(F.col(f"`{s}`")), zero).alias(names[s]) for s in S.SEGMENTS],
    )


def churn_by_region(drill: DataFrame) -> DataFrame:
    """Unweighted mean of the group churn rates, in percent."""
    pct = half_up(mean_rate("churn_rate") * F.lit(100.0), 2)
    return (
        drill.groupBy("region")
        .agg(pct.alias("churn_pct"))
        .withColumn("band", churn_band(F.col("churn_pct")))
    )


def revenue_impact(drill: DataFrame, rows: int = S.TOP_IMPACT_ROWS) -> DataFrame:
    """Largest plan and channel pairs. Customers are summed over months: customer-months."""
    grouped = drill.groupBy("plan_name", "channel").agg(
        money(F.sum("mrr")).alias("mrr"),
        F.sum("active_customers").alias("customer_months"),
        half_up(mean_rate("churn_rate") * F.lit(100.0), 1).alias("mean_churn_pct"),
        half_up(mean_rate("avg_usage_score"), 2).alias("mean_usage"),
    )
    arpu = F.coalesce(ratio(F.col("mrr"), F.col("customer_months")), F.lit(0.0))
    return (
        grouped.withColumn("arpu", arpu)
        .orderBy(F.desc("mrr"), "plan_name", "channel")
        .limit(rows)
    )


def slice_rows(drill: DataFrame, **choices) -> DataFrame:
    """Keeps rows that match every slicer; ``None`` or ``All`` leaves one open."""
    for name, value in choices.items():
        if name not in SLICERS:
            raise ValueError(f"unknown slicer {name!r}; expected one of {SLICERS}")
        if value not in (None, "All"):
            drill = drill.filter(F.col(name) == value)
    return drill


def drilldown_kpis(drill: DataFrame, **choices) -> DataFrame:
    """Totals under the slicers; zeros when nothing matches."""
    return slice_rows(drill, **choices).agg(
        F.coalesce(money(F.sum("mrr")), F.lit(0).cast(S.MONEY)).alias("mrr"),
        F.coalesce(F.sum("active_customers"), F.lit(0)).alias("customer_months"),
        half_up(mean_rate("churn_rate"), 6).alias("mean_churn_rate"),
        half_up(mean_rate("avg_usage_score"), 6).alias("mean_usage"),
    )


# ---- accounts at risk -------------------------------------------------------


def _high():
    return F.col("risk_tier") == "HIGH"


def risk_tier_counts(at_risk: DataFrame) -> DataFrame:
    """One row per tier, also for tiers without accounts."""
    tiers = ["HIGH", "MEDIUM", "LOW"]
    counts = at_risk.agg(*[F.count_if(F.col("risk_tier") == t).alias(t) for t in tiers])
    return counts.unpivot([], tiers, "risk_tier", "accounts")


def risk_drivers(at_risk: DataFrame) -> DataFrame:
    """Share of HIGH accounts showing each driver, integer percent."""
    signals = {
        "low_usage_pct": F.col("usage_score") < 0.3,
        "failed_payment_pct": F.col("failed_payments") > 0,
        "ticket_pct": F.col("support_tickets") >= 4,
    }
    return at_risk.agg(
        *[
            percent_of(F.count_if(_high() & hit), F.greatest(F.count_if(_high()), F.lit(1))).alias(name)
            for name, hit in signals.items()
        ]
    )


def risk_by_segment(at_risk: DataFrame) -> DataFrame:
    counts = at_risk.filter(_high()).groupBy("segment").agg(F.count("*").alias("accounts"))
    return counts.withColumn("share_pct", percent_of(F.col("accounts"), total_over("accounts")))


def risk_by_region(at_risk: DataFrame) -> DataFrame:
    """HIGH and MEDIUM counts for every region with any active account."""
    return at_risk.groupBy("region").agg(
        F.count_if(_high()).alias("high_accounts"),
        F.count_if(F.col("risk_tier") == "MEDIUM").alias("medium_accounts"),
    )


def top_risk_accounts(at_risk: DataFrame, rows: int = S.TOP_RISK_ACCOUNTS) -> DataFrame:
    return (
        at_risk.orderBy(F.desc("churn_risk_score"), "customer_id")
        .limit(rows)
        .select(
            "customer_id",
            "region",
            "plan_name",
            half_up_int(F.col("churn_risk_score")).alias("risk"),
            "risk_tier",
            "failed_payments",
            "support_tickets",
            "usage_score",
            "monthly_revenue",
        )
    )


# ---- cohort heatmap ---------------------------------------------------------


def shown_cohorts(grid: DataFrame, keep: int = S.HEATMAP_COHORTS) -> DataFrame:
    """Of rows per cohort: every second one when there are more than ``keep``, then the last ``keep``."""
    month = F.col("cohort_month")
    return (
        grid.withColumn("position", F.row_number().over(W.orderBy(month)) - 1)
        .withColumn("n_cohorts", F.count("*").over(W.partitionBy()))
        .filter((F.col("position") % 2 == 0) | (F.col("n_cohorts") <= keep))
        .orderBy(F.desc(month))
        .limit(keep)
        .drop("position", "n_cohorts")
    )


def cohort_heatmap(cohorts: DataFrame, periods: int = S.HEATMAP_PERIODS) -> DataFrame:
    """Integer retention percent and colour band per cohort for its first periods."""
    cells = cohorts.withColumn("pct", half_up_int(F.col("retention_rate") * F.lit(100.0)))
    # One aggregation by cohort, which is how the retention window left the rows.
    grid = cells.groupBy("cohort_month").agg(
        *[F.expr(f"max(pct) FILTER (WHERE period_num = {p})").alias(f"m{p}") for p in range(periods)]
    )
    return shown_cohorts(grid).select(
        "cohort_month",
        month_label("cohort_month").alias("cohort_label"),
        *[f"m{p}" for p in range(periods)],
        *[retention_band(f"m{p}").alias(f"band{p}") for p in range(periods)],
    )
