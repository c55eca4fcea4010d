"""Refresh-log queries and load verification."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S

LOG_COLUMNS = S.REFRESH_LOG.fieldNames()


def minute(ts="run_ts"):
    """UTC minute as text (the session zone is pinned to UTC)."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def without_clock(log: DataFrame) -> DataFrame:
    """What a run was and did, without when and how long."""
    return log.select(*[c for c in LOG_COLUMNS if c not in ("run_ts", "duration_ms")])


def recent(log: DataFrame, rows: int = S.RECENT_LOG_ROWS) -> DataFrame:
    """The newest runs with the text shown for each: rows loaded, or what went wrong."""
    detail = F.when(
        F.col("status") == "SUCCESS", F.concat(F.format_number("rows_loaded", 0), F.lit(" rows"))
    ).otherwise(F.coalesce("error_message", "status"))
    return (
        log.select(*LOG_COLUMNS)
        .orderBy(F.desc("run_ts"), F.desc("log_id"))
        .limit(rows)
        .select(
            "log_id",
            minute().alias("run_minute"),
            "triggered_by",
            "source_table",
            "rows_loaded",
            "rows_rejected",
            "status",
            "error_message",
            "duration_ms",
            detail.alias("detail"),
        )
    )


def latest(log: DataFrame) -> DataFrame:
    return (
        log.orderBy(F.desc("run_ts"), F.desc("log_id"))
        .limit(1)
        .select("triggered_by", "source_table", "rows_loaded", "status", "duration_ms")
    )


def retained(log: DataFrame, as_of, days: int = S.LOG_RETENTION_DAYS) -> DataFrame:
    """Rows no older than ``days`` before ``as_of`` (a timestamp Column)."""
    return log.filter(F.col("run_ts") >= as_of - F.make_dt_interval(F.lit(days)))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def fact_rows_json(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count("*").alias("fact_rows")).select(
        F.to_json(F.struct("fact_rows")).alias("result")
    )
