"""Customer dimension and fact rows from staging."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import risk_score

ATTRIBUTES = ["cohort_month", "region", "plan_type", "channel", "segment"]


def customer_keys(rows: DataFrame) -> list[str]:
    """What identifies a customer: the source's own key too, where staging carries it."""
    return [c for c in ("customer_key", "customer_id") if c in rows.columns]


def customers_in(stg: DataFrame) -> DataFrame:
    """One row per customer id; among conflicting attribute sets the smallest wins.

    Distinct attribute sets come first. That is a hash aggregation with a
    map-side part, so neither a long history nor a very frequent id reaches
    the ``min`` over structs, which sorts.
    """
    keys = customer_keys(stg)
    return (
        stg.select(*keys, *ATTRIBUTES)
        .distinct()
        .groupBy(*keys)
        .agg(F.min(F.struct(*ATTRIBUTES)).alias("first"))
        .select(*keys, "first.*")
    )


def new_customers(stg: DataFrame, existing: DataFrame | None) -> DataFrame:
    found = customers_in(stg)
    if existing is None:
        return found
    key = customer_keys(stg)[0]
    return found.join(existing.select(key), key, "left_anti")


def with_surrogate_keys(df: DataFrame, column: str, after: int = 0) -> DataFrame:
    """Unique long keys above ``after``, without an ordering over all rows; rows that have one keep it."""
    key = F.monotonically_increasing_id() + F.lit(after + 1)
    return df.withColumn(column, F.coalesce(column, key) if column in df.columns else key)


def fact_rows(good: DataFrame, customers: DataFrame) -> DataFrame:
    """Key lookup, projection and score. ``good`` carries ``plan_key`` already.

    Staging that brings its own ``customer_key`` needs no lookup: the
    dimension took its keys from there.
    """
    if "customer_key" not in good.columns:
        good = good.join(customers.select("customer_id", "customer_key"), "customer_id")
    return good.select(
        "customer_key",
        F.col("month").alias("date_key"),
        "plan_key",
        "monthly_revenue",
        "churn_flag",
        "active_flag",
        "usage_score",
        "support_tickets",
        "failed_payments",
        risk_score().alias("churn_risk_score"),
        "region",
        "segment",
    )


VALUES = [
    "plan_key",
    "monthly_revenue",
    "churn_flag",
    "active_flag",
    "usage_score",
    "support_tickets",
    "failed_payments",
    "region",
    "segment",
]


def changes(rows: DataFrame, fact: DataFrame, first, last) -> DataFrame:
    """Rows whose (customer, month) the fact lacks or holds with other values; the latter are ``known``.

    The fact is cut to the batch's months, which are partitions of it. Rows equal
    to what is stored are left out.
    """
    months = fact.filter(F.col("date_key").between(F.lit(first), F.lit(last)))
    stored = months.select("customer_key", "date_key", F.struct(*VALUES).alias("stored"))
    both = rows.join(stored, ["customer_key", "date_key"], "left")
    changed = both.filter(F.col("stored").isNull() | (F.col("stored") != F.struct(*VALUES)))
    return changed.withColumn("known", F.col("stored").isNotNull()).drop("stored")


def against_stored(rows: DataFrame, fact: DataFrame, first, last) -> tuple[DataFrame, DataFrame]:
    """(new, differing): rows whose (customer, month) the fact lacks, and corrections of those it holds."""
    found = changes(rows, fact, first, last)
    return found.filter("NOT known").drop("known"), found.filter("known").drop("known")


def corrected(changed: DataFrame, fact: DataFrame, anew: list) -> DataFrame:
    """All that the months in ``anew`` hold after a correction, and new rows of other months.

    Rows that stay as they are keep their key and time; the others have none yet.
    """
    differing = changed.filter("known").select("customer_key", "date_key")
    kept = fact.filter(F.col("date_key").isin(anew)).join(differing, ["customer_key", "date_key"], "left_anti")
    return kept.unionByName(changed.drop("known"), allowMissingColumns=True)


def orphans(fact: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows without a matching dimension row."""
    return fact.join(dimension.select(key), key, "left_anti")


