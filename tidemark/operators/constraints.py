"""Declared row constraints and unique keys, as queries for what breaks them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import flag

# The domains the tables declare.
FACT_RULES = [
    "customer_key IS NOT NULL AND date_key IS NOT NULL AND plan_key IS NOT NULL",
    "monthly_revenue IS NOT NULL AND region IS NOT NULL AND segment IS NOT NULL",
    "support_tickets IS NOT NULL AND failed_payments IS NOT NULL",
    "churn_flag IN (0, 1)",
    "active_flag IN (0, 1)",
    "usage_score BETWEEN 0 AND 1",
]
LOG_RULES = ["status IN ('SUCCESS', 'FAILED', 'PARTIAL')"]
THRESHOLD_RULES = ["direction IN ('ABOVE', 'BELOW')"]


def broken(rules: list[str]):
    """Whether any rule is false or unknown for a row."""
    kept = F.lit(True)
    for rule in rules:
        kept = kept & flag(F.expr(rule))
    return ~kept


def violations(df: DataFrame, domains: str | None, rules: list[str], unique: str | None, *keys: str) -> DataFrame:
    """(constraint_name, violations) of a table in one aggregation by its unique key.

    ``domains`` names the rows that break a rule, ``unique`` the key values that occur more than once.
    """
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(broken(rules)).alias("outside"))
    both = per_key.agg(
        F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    named = [(domains, "outside"), (unique, "repeated")]
    cells = [F.struct(F.lit(n).alias("constraint_name"), F.col(c).alias("violations")) for n, c in named if n]
    return both.select(F.explode(F.array(*cells)).alias("v")).select("v.*")
