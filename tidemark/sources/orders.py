"""Staging rows from order data: one row per account and month with an order.

The pipeline reduces before it moves data. Lines shrink to one row per
order, orders to one row per account and month (both with map-side
partial aggregation), and only that bounded grain - an account has at most
one row per calendar month - is joined and windowed by account. A single
order or account with a third of all input rows therefore stays spread out.
"""

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import anon_id, segment_of_plan

TABLES = ["orders", "lineitem", "customer", "nation", "region"]
# An account counts as churned in a month if no order follows in this many months.
CHURN_MONTHS = 12


def account_attributes(customer, nation, region) -> DataFrame:
    """Region, plan, channel and segment of every account."""
    americas = F.col("r_name") == "AMERICA"
    nations = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.when(americas & (F.col("n_nationkey") % 2 == 0), "North America")
        .when(americas, "LATAM")
        .when(F.col("r_name") == "ASIA", "APAC")
        .otherwise("EMEA")
        .alias("region"),
    )
    balance = F.col("c_acctbal")
    lane = F.col("c_custkey") % 4
    return customer.join(nations, "c_nationkey").select(
        F.col("c_custkey").alias("customer_key"),
        anon_id(F.concat(F.lit("cust_"), F.col("c_custkey").cast("string"))).alias("customer_id"),
        "region",
        F.when(balance < 2500, "Starter")
        .when(balance < 5500, "Growth")
        .when(balance < 8500, "Enterprise")
        .otherwise("Enterprise Plus")
        .alias("plan_type"),
        F.when(lane == 0, "Direct Sales")
        .when(lane == 1, "Partner")
        .when(lane == 2, "Self-Serve")
        .otherwise("Marketplace")
        .alias("channel"),
    )


def account_months(orders, lineitem) -> DataFrame:
    """Revenue, returns, failed payments and usage per account and month."""
    lines = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("units"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"),
    )
    failed = (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")
    return (
        orders.join(lines, "o_orderkey", "left")
        .groupBy(
            F.col("o_custkey").alias("customer_key"),
            F.trunc("o_orderdate", "MM").alias("month"),
        )
        .agg(
            F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("revenue"),
            F.coalesce(F.sum("returns"), F.lit(0)).alias("tickets"),
            F.count_if(failed).alias("failed"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("units"),
            F.coalesce(F.sum("n_lines"), F.lit(0)).alias("n_lines"),
        )
    )


def staging(orders, lineitem, customer, nation, region, churn_months=CHURN_MONTHS, buckets=None) -> DataFrame:
    """The 13 staging columns plus the source's own ``customer_key``; every account-month stays.

    Churn is what the orders show: no order of the account in the ``churn_months``
    after the month. Months whose following ``churn_months`` are not all in the
    data yet are not churned. An account may come back later.

    ``buckets`` fixes the hash partitioning by account that the join and the
    window need anyway, so that the result can be written in that many
    buckets without another shuffle.
    """
    usage_mils = F.coalesce(F.expr("(units * 20) div nullif(n_lines, 0)"), F.lit(0))
    last = orders.select(F.trunc(F.max("o_orderdate"), "MM")).scalar()
    by_account = W.partitionBy("customer_key")
    next_month = F.lead("month").over(by_account.orderBy("month"))
    horizon = F.add_months("month", churn_months)
    months = account_months(orders, lineitem)
    if buckets:
        months = months.repartition(buckets, "customer_key")
    return (
        months.join(account_attributes(customer, nation, region), "customer_key", "left")
        .withColumn("usage_mils", usage_mils)
        .withColumns({"cohort_month": F.min("month").over(by_account), "next_month": next_month})
        .withColumn(
            "churn_flag",
            F.when((horizon <= last) & (F.col("next_month").isNull() | (F.col("next_month") > horizon)), 1).otherwise(0),
        )
        .select(
            "customer_id",
            "month",
            "region",
            "plan_type",
            "channel",
            segment_of_plan().alias("segment"),
            F.col("revenue").cast(S.REVENUE).alias("monthly_revenue"),
            "churn_flag",
            F.lit(1).alias("active_flag"),
            (F.col("usage_mils").cast("decimal(10,0)") * F.lit(Decimal("0.001")))
            .cast("decimal(4,3)")
            .alias("usage_score"),
            F.col("tickets").cast("int").alias("support_tickets"),
            F.col("failed").cast("int").alias("failed_payments"),
            "cohort_month",
            "customer_key",
        )
    )


def read_tables(spark, sf_dir) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}


def staging_from(spark, sf_dir, buckets=None) -> DataFrame:
    return staging(**read_tables(spark, sf_dir), buckets=buckets)
