"""Small fixed tables and the month calendar.

They are VALUES relations and literal sequences: the planner knows their
size, so joins with them broadcast on the evidence and need no hint.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S


def values_table(spark, rows, columns) -> DataFrame:
    """A literal table from Python rows and a ``name TYPE, ...`` column list."""
    fields = [c.strip().split(" ", 1) for c in columns.replace(", ", "\n").split("\n")]

    def literal(value):
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).upper()
        if isinstance(value, (int, float)):
            return repr(value)
        return "'" + str(value).replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {body} AS t({names})")


def plans(spark) -> DataFrame:
    return values_table(spark, S.PLAN_ROWS, S.PLAN_COLUMNS)


def regions(spark) -> DataFrame:
    return values_table(spark, S.REGION_ROWS, S.REGION_COLUMNS)


def thresholds(spark) -> DataFrame:
    """The alert thresholds a new warehouse starts with; who changes them says so in the last two columns."""
    return (
        values_table(spark, S.THRESHOLD_ROWS, S.THRESHOLD_COLUMNS)
        .withColumn("last_updated_by", F.lit("seed"))
        .withColumn("last_updated_at", F.current_timestamp())
    )


def region_policy(spark) -> DataFrame:
    return values_table(spark, S.POLICY_ROWS, S.POLICY_COLUMNS)


def describe_months(months: DataFrame) -> DataFrame:
    """Calendar attributes for a frame of month starts in ``date_key``."""
    d = F.col("date_key")
    return months.select(
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        F.month(d).alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.weekofyear(d).alias("week_num"),
        (F.weekday(d) + 1).alias("day_of_week"),
        F.lit(True).alias("is_month_start"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"),
    )


def calendar(spark, first, last) -> DataFrame:
    """One row per month start from ``first`` to ``last``, both included."""
    span = F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("INTERVAL 1 MONTH"))
    return describe_months(spark.range(1).select(F.explode(span).alias("date_key")))
