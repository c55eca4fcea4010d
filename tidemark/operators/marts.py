"""The mart queries. Each takes tables and returns one row per group.

Each mart is one function of the fact, and what the stored suite reads is another one of
`cells`: sums per month, region, segment, plan and channel, which every
group mart adds up from. As an account has one row a month in a loaded fact, accounts
of different cells are different customers, and counts of them add up as well.

Stored fact and customer tables are bucketed by ``customer_key``
(``sources.warehouse``). Distinct customers, cohorts and the customer join
are all keyed by it, so these plans read the fact once and shuffle only
their group rows. On an unbucketed fact the same code shuffles, after
map-side partial aggregation.

Windows run on aggregated rows only: at most one row per month and region.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import (
    exact_mean,
    flag,
    money,
    months_between,
    ratio,
    risk_tier,
)


def newest(df: DataFrame, column: str, month=None) -> DataFrame:
    """Rows of the latest month, or of the one given, as a filter that reaches the scan."""
    return df.filter(F.col(column) == (df.select(F.max(column)).scalar() if month is None else month))


def mrr_monthly(fact: DataFrame) -> DataFrame:
    return _mrr(
        fact.groupBy(F.col("date_key").alias("month")).agg(
            money(F.sum("monthly_revenue")).alias("mrr"),
            F.countDistinct("customer_key").alias("active_customers"),
            F.sum("churn_flag").alias("churned"),
            F.count("*").alias("accounts"),
        )
    )


def _mrr(monthly: DataFrame) -> DataFrame:
    arpu = ratio(F.col("mrr"), F.col("active_customers"))
    churn = ratio(F.col("churned"), F.col("accounts"))
    before = F.lag("mrr").over(W.orderBy("month"))
    return monthly.select(
        "month",
        "mrr",
        money(F.col("mrr") * 12).alias("arr"),
        "active_customers",
        arpu.alias("arpu"),
        churn.alias("churn_rate"),
        (F.lit(1.0) - churn).alias("retention_rate"),
        money(F.col("mrr") - before).alias("mrr_change"),
        ratio(arpu, churn).alias("ltv_proxy"),
    )


def revenue_drilldown(fact: DataFrame, customers: DataFrame, plans: DataFrame) -> DataFrame:
    """Revenue and health by month, region, segment, plan and channel.

    Rows first collapse to one per customer and group. That bounds what the
    customer join sees of any one customer, and makes the distinct customer
    count a plain count, since a customer has exactly one channel.
    """
    per_customer = fact.groupBy("customer_key", "date_key", "region", "segment", "plan_key").agg(
        F.sum("monthly_revenue").alias("revenue"),
        F.sum("churn_flag").alias("churned"),
        F.count("*").alias("accounts"),
        F.sum("usage_score").alias("usage"),
        F.sum("support_tickets").alias("tickets"),
        F.sum("failed_payments").alias("failed"),
    )
    return (
        per_customer.join(customers.select("customer_key", "channel"), "customer_key")
        .join(plans.select("plan_key", "plan_name"), "plan_key")
        .groupBy(F.col("date_key").alias("month"), "region", "segment", "plan_name", "channel")
        .agg(
            money(F.sum("revenue")).alias("mrr"),
            F.count("*").alias("active_customers"),
            F.sum("churned").alias("churned_customers"),
            ratio(money(F.sum("revenue")), F.count("*")).alias("arpu"),
            ratio(F.sum("churned"), F.sum("accounts")).alias("churn_rate"),
            ratio(F.sum("usage"), F.sum("accounts")).alias("avg_usage_score"),
            F.sum("tickets").alias("total_support_tickets"),
            F.sum("failed").alias("total_failed_payments"),
        )
    )


def cohort_retention(fact: DataFrame) -> DataFrame:
    """Customers kept per cohort and month of life.

    The cohort is the customer's first fact month, churn rows included. One
    row per customer and month is left before the window, so no customer's
    group exceeds the number of months.
    """
    active = fact.groupBy("customer_key", "date_key").agg(
        F.min("churn_flag").alias("churned_everywhere")
    )
    first_month = F.min("date_key").over(W.partitionBy("customer_key"))
    return _retention(
        active.withColumn("cohort_month", first_month)
        .filter(F.col("churned_everywhere") == 0)
        .groupBy("cohort_month", months_between("date_key", "cohort_month").alias("period_num"))
        .agg(F.count("*").alias("retained_customers"))
    )


def _retention(periods: DataFrame) -> DataFrame:
    size = F.first("retained_customers").over(W.partitionBy("cohort_month").orderBy("period_num"))
    return periods.select(
        "cohort_month",
        "period_num",
        "retained_customers",
        size.alias("cohort_size"),
        ratio(F.col("retained_customers"), size).alias("retention_rate"),
    )


def accounts_at_risk(fact: DataFrame, customers: DataFrame, plans: DataFrame, month=None) -> DataFrame:
    """Accounts still active in the latest month, or the one given, with score and tier."""
    return at_risk_rows(newest(fact, "date_key", month), customers, plans).drop("seen_in")


def at_risk_rows(fact: DataFrame, customers: DataFrame, plans: DataFrame) -> DataFrame:
    """Account rows of the fact's months, and the region under which the fact has them."""
    current = fact.filter(F.col("churn_flag") == 0).withColumnRenamed("region", "seen_in").drop("segment")
    return (
        current.join(
            customers.select("customer_key", "customer_id", "region", "segment", "channel"),
            "customer_key",
        )
        .join(plans.select("plan_key", "plan_name"), "plan_key")
        .select(
            "customer_id",
            "region",
            "segment",
            "plan_name",
            "channel",
            F.col("date_key").alias("last_active_month"),
            "churn_risk_score",
            "usage_score",
            "support_tickets",
            "failed_payments",
            risk_tier().alias("risk_tier"),
            "monthly_revenue",
            "seen_in",
        )
    )


def region_months(fact: DataFrame) -> DataFrame:
    """Revenue, churn rate, mean risk and failed-payment rate per month and region."""
    return fact.groupBy("date_key", "region").agg(
        money(F.sum("monthly_revenue")).alias("mrr"),
        ratio(F.sum("churn_flag"), F.count("*")).alias("churn_rate"),
        exact_mean("churn_risk_score").alias("avg_risk_score"),
        ratio(F.sum("failed_payments"), F.count("*")).alias("failed_payment_rate"),
    )


def with_previous(monthly: DataFrame) -> DataFrame:
    """Adds the region's previous row; a missing month is spanned, not filled."""
    before = W.partitionBy("region").orderBy("date_key")
    return monthly.withColumns(
        {
            "prev_mrr": F.lag("mrr").over(before),
            "prev_churn_rate": F.lag("churn_rate").over(before),
        }
    )


def mrr_change_share():
    """Revenue change against the previous row, as an exact decimal fraction.

    Twenty digits per operand leave the quotient seventeen decimals.
    """
    now, before = F.col("mrr").cast("decimal(20,2)"), F.col("prev_mrr").cast("decimal(20,2)")
    return (now - before) / F.nullif(before, F.lit(0).cast("decimal(20,2)"))


def alerts(
    fact: DataFrame,
    churn_spike_rate: float = S.CHURN_SPIKE_RATE,
    revenue_drop_share: float = S.REVENUE_DROP_SHARE,
) -> DataFrame:
    return raised(region_months(fact), churn_spike_rate, revenue_drop_share)


def raised(
    regions: DataFrame,
    churn_spike_rate: float = S.CHURN_SPIKE_RATE,
    revenue_drop_share: float = S.REVENUE_DROP_SHARE,
) -> DataFrame:
    """Alert flags from rows of `region_months`."""
    monthly = with_previous(regions).filter(F.col("prev_mrr").isNotNull())
    change = mrr_change_share()
    churn_change = ratio(F.col("churn_rate") - F.col("prev_churn_rate"), F.col("prev_churn_rate"))
    return monthly.select(
        "date_key",
        "region",
        "mrr",
        "churn_rate",
        "prev_mrr",
        "prev_churn_rate",
        F.round(change * 100, 2).cast("double").alias("mrr_change_pct"),
        # The inner rounding drops binary noise, so 3.125 rounds as written.
        F.round(F.round(churn_change * 100, 10), 2).alias("churn_change_pct"),
        flag(F.col("churn_rate") > churn_spike_rate).alias("churn_spike_flag"),
        flag(change.cast("double") < revenue_drop_share).alias("revenue_drop_flag"),
    )


def revenue_mix(fact: DataFrame, plans: DataFrame) -> DataFrame:
    return (
        fact.groupBy("date_key", "segment", "plan_key", "region")
        .agg(
            F.sum("monthly_revenue").alias("revenue"),
            F.countDistinct("customer_key").alias("customers"),
        )
        .join(plans.select("plan_key", "plan_name"), "plan_key")
        .select(
            F.col("date_key").alias("month"),
            "segment",
            F.col("plan_name").alias("plan_type"),
            "region",
            money(F.col("revenue")).alias("mrr"),
            "customers",
        )
    )


def health_signals(fact: DataFrame) -> DataFrame:
    """Usage, support load and risk. Only high-risk keys travel for the distinct count."""
    risky = F.when(F.col("churn_risk_score") >= S.HIGH_RISK, F.col("customer_key"))
    return fact.groupBy(F.col("date_key").alias("month"), "region", "segment").agg(
        exact_mean("usage_score").alias("avg_usage_score"),
        F.sum("support_tickets").alias("total_tickets"),
        F.sum("failed_payments").alias("total_failed_payments"),
        exact_mean("churn_risk_score").alias("avg_risk_score"),
        F.countDistinct(risky).alias("high_risk_count"),
    )


# ---- from stored rows -------------------------------------------------------


def cells(fact: DataFrame, customers: DataFrame, plans: DataFrame) -> DataFrame:
    """What the group marts add up from; as many rows as the lists of groups allow, however large the fact."""
    per_group = (
        fact.join(customers.select("customer_key", "channel"), "customer_key")
        .groupBy(F.col("date_key").alias("month"), "region", "segment", "plan_key", "channel")
        .agg(
            money(F.sum("monthly_revenue")).alias("mrr"),
            F.count("*").alias("accounts"),
            F.sum("churn_flag").alias("churned"),
            F.sum("usage_score").alias("usage"),
            F.sum("support_tickets").alias("tickets"),
            F.sum("failed_payments").alias("failed"),
            F.sum("churn_risk_score").alias("risk"),
            F.count_if(F.col("churn_risk_score") >= S.HIGH_RISK).alias("high_risk"),
        )
    )
    return per_group.join(plans.select("plan_key", "plan_name"), "plan_key").drop("plan_key")


def customer_bits(fact: DataFrame, customers: DataFrame, plans: DataFrame) -> DataFrame:
    """The customers of each cell as bitmaps, which add up over cells and months as counts do not.

    A bitmap has a bit for each of 32768 consecutive customer keys, so keys should be dense. Rows move to the
    task of their month and keys before they become bitmaps: stored by hash of the key, each task has rows of nearly every
    bitmap, and bitmaps of 4 KB would be as many as tasks times cells.
    """
    key = F.col("customer_key")
    by = ["month", "region", "segment", "plan_key", "channel", "bucket"]
    rows = (
        fact.withColumnRenamed("date_key", "month")
        .join(customers.select("customer_key", "channel"), "customer_key")
        .select(*by[:-1], F.bitmap_bucket_number(key).alias("bucket"), F.bitmap_bit_position(key).alias("bit"))
    )
    return (
        rows.repartition("month", "bucket")
        .groupBy(*by)
        .agg(F.bitmap_construct_agg("bit").alias("bits"))
        .join(plans.select("plan_key", "plan_name"), "plan_key")
        .drop("plan_key")
    )


def distinct_customers(bits: DataFrame, *by: str) -> DataFrame:
    """Exact distinct customers of any rows of `customer_bits`, by any of its columns."""
    merged = bits.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*by).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("customers"))


def _summed(cells: DataFrame, *by) -> DataFrame:
    sums = ("accounts", "churned", "usage", "tickets", "failed", "risk", "high_risk")
    return cells.groupBy(*by).agg(money(F.sum("mrr")).alias("mrr"), *[F.sum(c).alias(c) for c in sums])


def mrr_of(cells: DataFrame) -> DataFrame:
    return _mrr(_summed(cells, "month").withColumn("active_customers", F.col("accounts")))


def drilldown_of(cells: DataFrame) -> DataFrame:
    return cells.select(
        "month",
        "region",
        "segment",
        "plan_name",
        "channel",
        "mrr",
        F.col("accounts").alias("active_customers"),
        F.col("churned").alias("churned_customers"),
        ratio(F.col("mrr"), F.col("accounts")).alias("arpu"),
        ratio(F.col("churned"), F.col("accounts")).alias("churn_rate"),
        ratio(F.col("usage"), F.col("accounts")).alias("avg_usage_score"),
        F.col("tickets").alias("total_support_tickets"),
        F.col("failed").alias("total_failed_payments"),
    )


def region_months_of(cells: DataFrame) -> DataFrame:
    return _summed(cells, F.col("month").alias("date_key"), "region").select(
        "date_key",
        "region",
        "mrr",
        ratio(F.col("churned"), F.col("accounts")).alias("churn_rate"),
        ratio(F.col("risk"), F.col("accounts")).alias("avg_risk_score"),
        ratio(F.col("failed"), F.col("accounts")).alias("failed_payment_rate"),
    )


def region_totals_of(cells: DataFrame) -> DataFrame:
    return _summed(cells, F.col("month").alias("date_key"), "region").select(
        "date_key", "region", "mrr", F.col("accounts").alias("account_months"), F.col("churned").alias("churned_customers")
    )


def mix_of(cells: DataFrame) -> DataFrame:
    summed = _summed(cells, "month", "segment", F.col("plan_name").alias("plan_type"), "region")
    return summed.select("month", "segment", "plan_type", "region", "mrr", F.col("accounts").alias("customers"))


def health_of(cells: DataFrame) -> DataFrame:
    return _summed(cells, "month", "region", "segment").select(
        "month",
        "region",
        "segment",
        ratio(F.col("usage"), F.col("accounts")).alias("avg_usage_score"),
        F.col("tickets").alias("total_tickets"),
        F.col("failed").alias("total_failed_payments"),
        ratio(F.col("risk"), F.col("accounts")).alias("avg_risk_score"),
        F.col("high_risk").alias("high_risk_count"),
    )


def customer_months(fact: DataFrame) -> DataFrame:
    """First and last month per customer and region; rows of several loads merge by min and max."""
    return fact.groupBy("customer_key", "region").agg(
        F.min("date_key").alias("first_month"), F.max("date_key").alias("last_month")
    )


def first_months(months: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per customer, per customer and region), merged from rows of `customer_months`."""
    here = months.groupBy("customer_key", "region").agg(F.min("first_month").alias("cohort_here"))
    return months.groupBy("customer_key").agg(F.min("first_month").alias("cohort_month")), here


def cohort_cells(fact: DataFrame, months: DataFrame) -> DataFrame:
    """Active customers by month, region, cohort, and cohort among the rows of that region.

    First months come from the customers' state, so that the fact is read in the months asked for only.
    """
    everywhere, here = first_months(months)
    active = fact.filter(F.col("churn_flag") == 0).select("customer_key", "date_key", "region")
    return (
        active.join(everywhere, "customer_key")
        .join(here, ["customer_key", "region"])
        .groupBy(F.col("date_key").alias("month"), "region", "cohort_month", "cohort_here")
        .agg(F.count("*").alias("retained"))
    )


def cohorts_of(cells: DataFrame, cohort: str = "cohort_month") -> DataFrame:
    """Retention from `cohort_cells`; by ``cohort_here`` for one region on its own."""
    named = cells.select(F.col(cohort).alias("cohort_month"), "month", "retained")
    period = months_between("month", "cohort_month").alias("period_num")
    return _retention(named.groupBy("cohort_month", period).agg(F.sum("retained").alias("retained_customers")))
