"""Row security as data operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import money


def visible_fact(fact: DataFrame, policy: DataFrame, user: str | None) -> DataFrame:
    """The fact rows a user may see; ``None`` is an administrator and sees all.

    A semi-join on the fact's own region column, before any aggregation. A
    user without a policy row sees nothing.
    """
    return visible(fact, policy, user)


def allowed(policy: DataFrame, user: str) -> DataFrame:
    return policy.filter(F.col("db_user") == user).select("region")


def visible(rows: DataFrame, policy: DataFrame, user: str | None, region: str = "region") -> DataFrame:
    """The rows of a table whose region column the user may see.

    Where the table is partitioned by region, Spark prunes its partitions by the policy's rows.
    """
    if user is None:
        return rows
    return rows.join(allowed(policy, user).withColumnRenamed("region", region), region, "left_semi")


def region_totals(fact: DataFrame) -> DataFrame:
    return fact.groupBy("date_key", "region").agg(
        money(F.sum("monthly_revenue")).alias("mrr"),
        F.count("*").alias("account_months"),
        F.sum("churn_flag").alias("churned_customers"),
    )


def analyst_top_risk(top_rows: DataFrame, policy: DataFrame, user: str) -> DataFrame:
    """The analyst's part of the top list: the filter comes after the cut."""
    return visible(top_rows, policy, user)


def visible_mrr(mix: DataFrame) -> DataFrame:
    """Revenue of the visible rows, 0 when there are none."""
    return mix.agg(F.coalesce(money(F.sum("mrr")), F.lit(0).cast(S.MONEY)).alias("mrr"))
