"""Active alerts, the alert feed, and the threshold evaluator."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import half_up, month_label, ratio
from tidemark.operators.marts import region_months, with_previous


def enabled(thresholds: DataFrame) -> DataFrame:
    return thresholds.filter("enabled").select(
        "metric_name",
        F.col("warning_threshold").cast("double").alias("warn_at"),
        F.col("critical_threshold").cast("double").alias("critical_at"),
        "direction",
    )


def _at_month(rows: DataFrame, month=None) -> DataFrame:
    if month is not None:
        return rows.filter(F.col("date_key") == month)
    # A window over alert rows (months x regions), so the mart is built once.
    latest = F.max("date_key").over(W.partitionBy())
    return rows.withColumn("latest", latest).filter(F.col("date_key") == F.col("latest")).drop("latest")


def active_alerts(alerts: DataFrame, thresholds: DataFrame, month=None) -> DataFrame:
    """Flagged regions of the newest month, or of the one given, with a severity; a region may appear twice.

    ``mrr_change_pct`` is a percentage while the seeded drop thresholds are
    fractions, so a flagged drop always comes out CRITICAL. That is the
    documented behaviour of this view; ``threshold_alerts`` compares fractions.
    """
    kinds = F.array(
        F.when(
            F.col("churn_spike_flag"),
            F.struct(
                F.lit("CHURN_SPIKE").alias("alert_type"),
                F.lit("monthly_churn_rate").alias("metric_name"),
                F.col("churn_rate").alias("metric_value"),
            ),
        ),
        F.when(
            F.col("revenue_drop_flag"),
            F.struct(
                F.lit("REVENUE_DROP").alias("alert_type"),
                F.lit("mrr_drop_pct").alias("metric_name"),
                F.col("mrr_change_pct").alias("metric_value"),
            ),
        ),
    )
    raised = (
        _at_month(alerts, month)
        .select("date_key", "region", F.explode(F.array_compact(kinds)).alias("raised"))
        .select("date_key", "region", "raised.*")
    )
    value = F.col("metric_value")
    above = F.col("alert_type") == "CHURN_SPIKE"

    def reached(limit):
        return F.when(above, value >= F.col(limit)).otherwise(value <= F.col(limit))

    return raised.join(enabled(thresholds), "metric_name", "left").select(
        "date_key",
        "region",
        "alert_type",
        "metric_value",
        F.when(reached("critical_at"), "CRITICAL")
        .when(reached("warn_at"), "WARNING")
        .otherwise("OK")
        .alias("severity"),
    )


def alert_feed(alerts: DataFrame, rows: int = S.ALERT_FEED_ROWS) -> DataFrame:
    """The newest flagged month and region rows; a churn spike hides a drop."""
    spike = F.col("churn_spike_flag")
    return (
        alerts.filter(spike | F.col("revenue_drop_flag"))
        .orderBy(F.desc("date_key"), "region")
        .limit(rows)
        .select(
            "date_key",
            month_label("date_key").alias("month_label"),
            "region",
            F.when(spike, "CHURN_SPIKE").otherwise("REVENUE_DROP").alias("alert_type"),
            F.when(spike, "Churn rate").otherwise("MRR change").alias("label"),
            F.when(spike, half_up(F.col("churn_rate") * 100, 2))
            .otherwise(F.col("mrr_change_pct"))
            .alias("value"),
            F.lit("%").alias("unit"),
        )
    )


def feed_severity(feed: DataFrame, churn_pct: float = 8.0, drop_pct: float = 5.0) -> DataFrame:
    """Severity of feed rows under caller-chosen limits, in percent."""
    spike = F.col("alert_type") == "CHURN_SPIKE"
    size = F.when(spike, F.col("value")).otherwise(F.abs("value"))
    limit = F.when(spike, F.lit(float(churn_pct))).otherwise(F.lit(float(drop_pct)))
    critical = F.when(spike, F.lit(churn_pct * 1.3)).otherwise(F.lit(drop_pct * 1.5))
    return feed.select(
        "date_key",
        "month_label",
        "region",
        "alert_type",
        F.replace("alert_type", F.lit("_"), F.lit(" ")).alias("title"),
        "label",
        "value",
        F.when(spike, F.lit(float(churn_pct))).otherwise(F.lit(-float(drop_pct))).alias("threshold_pct"),
        F.when(size < limit, "RESOLVED")
        .when(size >= critical, "CRITICAL")
        .otherwise("WARNING")
        .alias("severity"),
    )


METRICS = ["monthly_churn_rate", "mrr_drop_pct", "avg_risk_score", "failed_payment_rate"]


def region_metrics(fact: DataFrame) -> DataFrame:
    """Long form: one row per month, region and metric that has a value."""
    return metrics_of(region_months(fact))


def metrics_of(regions: DataFrame) -> DataFrame:
    """The same from rows of `region_months`."""
    change = ratio(F.col("mrr") - F.col("prev_mrr"), F.col("prev_mrr"))
    wide = with_previous(regions).select(
        "date_key",
        "region",
        F.col("churn_rate").alias("monthly_churn_rate"),
        change.alias("mrr_drop_pct"),
        "avg_risk_score",
        "failed_payment_rate",
    )
    return wide.unpivot(["date_key", "region"], METRICS, "metric_name", "metric_value").filter(
        F.col("metric_value").isNotNull()
    )


def threshold_alerts(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every metric value against its enabled threshold, in the threshold's direction."""
    value = F.col("metric_value")
    above = F.col("direction") == "ABOVE"

    def reached(limit):
        return F.when(above, value >= F.col(limit)).otherwise(value <= F.col(limit))

    return metrics.join(enabled(thresholds), "metric_name").select(
        "date_key",
        "region",
        "metric_name",
        "metric_value",
        F.when(reached("critical_at"), "CRITICAL")
        .when(reached("warn_at"), "WARNING")
        .otherwise("OK")
        .alias("severity"),
    )
