"""Staging input: CSV in and out, type coercion, and row validation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S

COLUMNS = S.STAGING.fieldNames()
# What is wrong with the line a row came from, and its text: the whole line, or the fields that do not parse.
FAULT, LINE = "line_fault", "line"
_RAW = "_corrupt_record"
# The header must name the declared columns in order.
CSV_OPTIONS = {"header": True, "enforceSchema": False, "mode": "PERMISSIVE"}
TEXT_COLUMNS = ", ".join(f"{c} STRING" for c in [*COLUMNS, _RAW])
# A comma with an even number of quotes behind it separates fields.
SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def read_csv(spark, path, header=True) -> DataFrame:
    """The 13-column CSV. The schema is declared, never inferred.

    Lines that are not 13 fields and fields that do not parse are kept as text beside the
    row, in ``line_fault`` and ``line``, and then rejected by ``classify``, so one bad line
    does not end the run. A file with other columns does.
    """
    return parsed(spark.read.schema(TEXT_COLUMNS).options(**CSV_OPTIONS | {"header": header}).csv(path))


def parsed(lines: DataFrame) -> DataFrame:
    """Typed staging rows from rows of ``TEXT_COLUMNS``, with what is wrong with their lines."""
    raw = F.col(_RAW)
    fields = F.size(F.split(raw, SEPARATOR))
    quotes = F.length(raw) - F.length(F.replace(raw, F.lit('"')))
    broken = (
        F.when(quotes % 2 == 1, "broken_quote")
        .when(fields > len(COLUMNS), "surplus_fields")
        .when(fields < len(COLUMNS), "missing_fields")
        .otherwise("unreadable_line")
    )
    # Text that is there and is not a value of the declared type.
    unread = [
        F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.struct(F.lit(f.name).alias("k"), F.col(f.name).alias("v")))
        for f in S.STAGING.fields
        if f.dataType.typeName() != "string"
    ]
    unread = F.map_from_entries(F.array_compact(F.array(*unread)))
    fault = F.when(raw.isNotNull(), broken).when(F.size(unread) > 0, "unparsable_value")
    text = F.when(raw.isNotNull(), raw).when(F.size(unread) > 0, F.to_json(unread))
    return lines.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in S.STAGING.fields], fault.alias(FAULT), text.alias(LINE)
    )


def staged(rows: DataFrame) -> DataFrame:
    """The columns that staging holds: the 13, and what is wrong with a row's line where that is known."""
    of_line = [F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in (FAULT, LINE)]
    return rows.select(*COLUMNS, *of_line)


def read_csv_text(spark, path) -> DataFrame:
    """The same file with every column as text, for ``coerce``; lines of other than 13 fields lose their text."""
    return spark.read.schema(", ".join(f"{c} STRING" for c in COLUMNS)).options(**CSV_OPTIONS).csv(path)


def write_csv(df: DataFrame, path) -> None:
    df.select(*COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def coerce(df: DataFrame) -> DataFrame:
    """Casts loosely typed rows (text, doubles) to the declared types."""
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in S.STAGING.fields])


def classify(stg: DataFrame, plans: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds ``plan_key`` and ``reject_reason``; a NULL reason marks a good row.

    Neither lookup shuffles the staging rows: plans are literal rows, and the
    calendar is broadcast, a date for each month of a span set by argument.
    """
    known_plans = plans.select(F.col("plan_name").alias("plan_type"), "plan_key")
    known_months = calendar.select(F.col("date_key").alias("month"), F.lit(True).alias("in_calendar"))
    missing = F.lit(False)
    for name in COLUMNS:
        missing = missing | F.col(name).isNull()
    broken = F.col(FAULT) if FAULT in stg.columns else F.lit(None).cast("string")
    reason = (
        F.when(broken.isNotNull(), broken)
        .when(missing, "missing_value")
        .when(~F.col("churn_flag").isin(0, 1) | ~F.col("active_flag").isin(0, 1), "flag_not_0_or_1")
        .when(~F.col("usage_score").between(0, 1), "usage_out_of_range")
        .when(F.col("plan_key").isNull(), "unknown_plan")
        .when(F.col("in_calendar").isNull(), "month_outside_calendar")
    )
    return (
        stg.join(known_plans, "plan_type", "left")
        .join(F.broadcast(known_months), "month", "left")
        .withColumn("reject_reason", reason)
        .drop("in_calendar")
    )


def one_per_account_month(good: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, refused): one row per customer id and month, the smallest, and the others.

    Equal rows are counted first, by a hash aggregation with a map-side part, so
    a row repeated in a third of the input travels as one. ``refused`` has the
    number of refused ``copies``.
    """
    keys = ["customer_id", "month"]
    rest = [c for c in good.columns if c not in (*keys, "reject_reason", FAULT, LINE)]
    counted = good.groupBy(*keys, *rest).agg(F.count("*").alias("copies"))
    first = counted.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("first"))
    kept_copy = F.when(F.struct(*rest) == F.col("first"), 1).otherwise(0)
    refused = counted.join(first, keys).withColumn("copies", F.col("copies") - kept_copy)
    return first.select(*keys, "first.*"), refused.filter("copies > 0").drop("first")


def reject_rows(rows: DataFrame, load_id: int, reason=None) -> DataFrame:
    """Rows as they are kept in the table of rejects."""
    values = [c for c in rows.columns if c not in ("reject_reason", "copies", "plan_key")]
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    return rows.select(
        F.lit(load_id).cast("bigint").alias("load_id"),
        (F.col("reject_reason") if reason is None else F.lit(reason)).alias("reject_reason"),
        copies.cast("bigint").alias("copies"),
        F.to_json(F.struct(*values)).alias("row"),
    )


def reject_counts(rejects: DataFrame) -> DataFrame:
    """Refused rows by reason, from the stored rejects."""
    return rejects.groupBy("reject_reason").agg(F.sum("copies").alias("rows_rejected"))
