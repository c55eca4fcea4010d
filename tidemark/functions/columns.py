"""Column expressions. All are built-in Spark functions, so they stay in codegen."""

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import schemas as S

__all__ = [
    "anon_id",
    "churn_band",
    "exact_mean",
    "flag",
    "half_up",
    "half_up_int",
    "mean_rate",
    "money",
    "month_label",
    "months_between",
    "percent_of",
    "ratio",
    "region_label",
    "retention_band",
    "risk_score",
    "risk_tier",
    "segment_of_plan",
]


def money(c: Column) -> Column:
    return c.cast(S.MONEY)


def ratio(num: Column, den: Column) -> Column:
    """num / den as double; NULL for a zero denominator (ANSI mode would raise)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def exact_mean(c) -> Column:
    """Mean of a decimal column: exact sum, one division, so no order dependence."""
    return ratio(F.sum(c), F.count(c))


def mean_rate(c) -> Column:
    """Unweighted mean of double rates, 0 for no rows.

    The rates are summed as decimals: a double sum would change with the
    order in which partitions arrive.
    """
    total = F.sum(F.col(c).cast("decimal(20,15)")).cast("double")
    return F.coalesce(total, F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1)).cast("double")


def half_up(c: Column, digits: int) -> Column:
    """Rounds to n digits with halves upward."""
    scale = float(10**digits)
    return F.floor(c * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def half_up_int(c: Column) -> Column:
    """Nearest integer, halves toward +infinity."""
    return F.floor(c.cast("double") + F.lit(0.5)).cast("int")


def percent_of(part: Column, whole: Column) -> Column:
    """Integer percent, 0 when the whole is 0 or missing."""
    return F.coalesce(half_up_int(ratio(part, whole) * F.lit(100.0)), F.lit(0))


def flag(cond: Column) -> Column:
    """TRUE or FALSE; an unknown condition counts as FALSE."""
    return F.coalesce(cond, F.lit(False))


def months_between(later, earlier) -> Column:
    """Whole calendar months between two month starts."""
    later, earlier = F.col(later), F.col(earlier)
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")


def month_label(c) -> Column:
    """Such as ``Dec 24``."""
    return F.date_format(c, "MMM yy")


def risk_score(failed="failed_payments", tickets="support_tickets", usage="usage_score") -> Column:
    """0 to 100: 30 per failed payment, 10 per ticket up to five, 40 for no usage at all."""
    failures = F.col(failed) * F.lit(Decimal("30.0"))
    support = F.least(F.col(tickets), F.lit(5)) * F.lit(Decimal("10.0"))
    idle = (F.lit(Decimal("1.0")) - F.col(usage)) * F.lit(Decimal("40.0"))
    return F.least(F.lit(Decimal(100)), failures + support + idle).cast(S.SCORE)


def risk_tier(score="churn_risk_score") -> Column:
    score = F.col(score)
    return (
        F.when(score >= S.HIGH_RISK, "HIGH").when(score >= S.MEDIUM_RISK, "MEDIUM").otherwise("LOW")
    )


def segment_of_plan(plan="plan_type") -> Column:
    plan = F.col(plan)
    return (
        F.when(plan.isin("Enterprise", "Enterprise Plus"), "Enterprise")
        .when(plan == "Growth", "Mid-Market")
        .otherwise("SMB")
    )


def anon_id(text: Column) -> Column:
    """Pseudonymous id: prefix and the first 12 hex digits of SHA-256, upper case."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.concat(F.lit("CUST_"), F.upper(F.substring(digest, 1, 12)))


def churn_band(percent: Column) -> Column:
    return F.when(percent >= 6, "red").when(percent >= 5, "amber").otherwise("green")


def retention_band(percent: str) -> Column:
    """Band of an integer percent column; one SQL expression, as twelve of them are built."""
    return F.expr(
        f"CASE WHEN {percent} IS NULL THEN 'none' WHEN {percent} >= 90 THEN '90+' "
        f"WHEN {percent} >= 80 THEN '80-89' WHEN {percent} >= 70 THEN '70-79' "
        f"WHEN {percent} >= 60 THEN '60-69' ELSE '<60' END"
    )


def region_label(region="region") -> Column:
    return F.when(F.col(region) == "North America", "N. America").otherwise(F.col(region))
