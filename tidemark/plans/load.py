"""The load job: staging -> customer dimension -> fact -> marts -> publication -> audit row.

Every step writes a table's part of this load and the next one reads it, so a lost executor
costs its tasks. Nothing is seen before the load is published, and then all of it: a
load that fails on the way leaves readers the tables of the load before.

A rerun of the same staging rows adds nothing: customers and (customer, month) pairs already
stored are left out. Rows that cannot be loaded are counted, and kept with their reason:
rows that fail a constraint, months outside the stored calendar, second rows of
an account and month, and rows that differ from the one stored. On request those replace what
is stored: their months are then written anew, and the old rows stay in the files of the load
that wrote them.

A load reads the months that it touches and no others: marts are stored by load and month,
cohorts come from a table of each customer's first months, and the rest is in the pointer.

Command line::

    python -m tidemark.plans.load --csv IN.csv --warehouse DIR \\
        --first-month 2023-01-01 --last-month 2025-12-01 --run-by manual:me
"""

import argparse
import math
import time
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators import audit, marts
from tidemark.operators import fact as facts
from tidemark.sources import seeds, staging, warehouse
from tidemark.sources.orders import CHURN_MONTHS
from tidemark.sources.warehouse import (
    AT_RISK,
    BITS,
    CALENDAR,
    CELLS,
    COHORTS,
    CUSTOMER_MONTHS,
    CUSTOMERS,
    FACT,
    LOG,
    REJECTS,
    STAGING,
)

# Input per shuffle partition. Pruned columns and partial aggregates leave a
# few percent of it to move, so partitions stay near 100 MB.
SHUFFLE_BYTES = 2 << 30
# Scan tasks to aim at; larger inputs get larger splits, up to 1 GB. Well packed files hold many rows in
# a split, all of which a task may sort or group before it moves them.
SCAN_TASKS = 200_000
MIN_SPLIT, MAX_SPLIT = 32 << 20, 1 << 30
# Marts are partitioned by region; more than so many are no regions.
MOST_REGIONS = 1000


@dataclass(frozen=True)
class LoadResult:
    rows_loaded: int
    rows_rejected: int
    status: str


@contextmanager
def load_settings(spark, input_bytes, buckets):
    """Session settings for the duration of a load.

    Shuffle partitions and scan splits follow the input size; without one, the
    session's partition count stands. Partitions are a multiple of the buckets:
    a partition hashed by customer then falls into one bucket, and its task
    writes one file. Bucketed tables are read bucket by bucket, so rows stay hashed as
    stored, and joins on the customer and more columns use that.
    """
    partitions = "spark.sql.shuffle.partitions"
    if input_bytes:
        wanted = max(spark.sparkContext.defaultParallelism, math.ceil(input_bytes / SHUFFLE_BYTES))
    else:
        wanted = int(spark.conf.get(partitions))
    settings = {
        partitions: str(buckets * math.ceil(wanted / buckets)),
        "spark.sql.files.maxPartitionBytes": f"{min(MAX_SPLIT, max(MIN_SPLIT, input_bytes // SCAN_TASKS))}b",
        "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def write_audit(wh, number, run_by, status, loaded=0, rejected=0, error=None, started=None, at=None):
    """One log row, under the number that the load claimed."""
    elapsed = None if started is None else int((time.monotonic() - started) * 1000)
    row = wh.spark.range(1).select(
        F.lit(number).cast("bigint").alias("log_id"),
        (F.current_timestamp() if at is None else F.lit(at)).cast("timestamp").alias("run_ts"),
        F.lit(run_by).alias("triggered_by"),
        F.lit(FACT).alias("source_table"),
        F.lit(loaded).cast("bigint").alias("rows_loaded"),
        F.lit(rejected).cast("bigint").alias("rows_rejected"),
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
        F.lit(elapsed).cast("bigint").alias("duration_ms"),
    )
    wh.append_log(row)


def together(*jobs):
    """Results of independent jobs; side by side they fill the cluster where one has few tasks."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [job.result() for job in [pool.submit(job) for job in jobs]]


def dense_keys(wh, rows: DataFrame, column: str, after: int, name: str) -> DataFrame:
    """Rows with keys ``after`` + 1, + 2, ... without gaps, written so that they stay as numbered.

    Rows are numbered within the partitions that write them; counts per partition, a row each,
    give where each partition's numbers begin. No row is sorted or moved for it.
    """
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = wh.scratch(rows.withColumns({"_of": F.spark_partition_id(), "_nth": within}), name)
    counts = numbered.groupBy("_of").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_of", before.alias("_start"))
    key = F.col("_start") + F.col("_nth") + F.lit(after + 1)
    # As many rows as the write had tasks.
    return numbered.join(F.broadcast(starts), "_of").withColumn(column, key).drop("_of", "_nth", "_start")


def _iso(month) -> str:
    return month.isoformat()


def _months_back(month: str, months: int) -> str:
    at = date.fromisoformat(month)
    total = at.year * 12 + at.month - 1 - months
    return date(total // 12, total % 12 + 1, 1).isoformat()


def observed_month(state) -> str | None:
    """The newest month whose churn is in the data: rows reach ``CHURN_MONTHS`` beyond it; else the newest."""
    newest = state.newest()
    if newest is None:
        return None
    limit = _months_back(newest, CHURN_MONTHS)
    return max((m for m in state.rows if m <= limit), default=newest)


def _load(wh, number, stg, calendar, plans, account_grain, correct, step):
    spark, base = wh.spark, wh.published()
    before = wh.bound(base)
    state = replace(base, loads=(*base.loads, number), staging=number)
    own = wh.bound(state)
    buckets = wh.layout() or wh.fix_layout(wh.buckets)
    # At account grain: one row per account and month, with the account's key.
    kept_rows = stg if account_grain else staging.staged(stg)
    _, _, stored = together(
        wh.prepare,
        lambda: _grow_calendar(wh, before, number, calendar),
        lambda: wh.add(kept_rows, STAGING, number, buckets if account_grain else 0),
    )
    step(CALENDAR)
    step(STAGING)

    plans = seeds.plans(spark) if plans is None else plans
    classified = staging.classify(stored, plans, own.read(CALENDAR))
    is_good = F.col("reject_reason").isNull()
    good_month = F.when(is_good, F.col("month"))
    summary = classified.agg(
        F.count_if(is_good).alias("good"),
        F.count_if(~is_good).alias("rejected"),
        F.min(good_month).alias("lo"),
        F.max(good_month).alias("hi"),
        F.approx_count_distinct(F.when(is_good, F.col("region"))).alias("regions"),
    ).first()
    if summary["regions"] > MOST_REGIONS:
        raise ValueError(f"about {summary['regions']} different regions; a mart has a partition for each")
    if summary["rejected"]:
        wh.add(staging.reject_rows(classified.filter(~is_good), number), REJECTS, number)
    good = classified.filter(is_good)
    if not account_grain:
        kept, refused = staging.one_per_account_month(good.drop("reject_reason"))
        good = wh.scratch(kept, f"good-{number}")
        if good.count() < summary["good"]:
            wh.add(staging.reject_rows(refused, number, "repeated_account_month"), REJECTS, number)
    step(REJECTS)

    fresh = facts.new_customers(good, before.get(CUSTOMERS))
    if not account_grain:
        fresh = dense_keys(wh, fresh, "customer_key", base.top_customer_key, f"new_customers-{number}")
        fresh = warehouse.co_locate(fresh, buckets)
    fresh = fresh.withColumn("created_at", F.current_timestamp()).select(*S.CUSTOMER.fieldNames())
    added = wh.add(fresh, CUSTOMERS, number, buckets)
    if not account_grain:
        top_customer = added.agg(F.max("customer_key")).first()[0]
        state = replace(state, top_customer_key=top_customer or base.top_customer_key)
    customers = own.read(CUSTOMERS)
    step(CUSTOMERS)

    rows = facts.fact_rows(good, customers)
    if not account_grain:
        rows = warehouse.co_locate(rows, buckets)
    anew = []
    fact = before.get(FACT)
    if fact is not None and summary["lo"] is not None:
        # Stored, so that the batch is compared once, whatever is done with what differs.
        changed = wh.scratch(facts.changes(rows, fact, summary["lo"], summary["hi"]), f"changes-{number}")
        differing = changed.filter("known").drop("known")
        if correct:
            anew = sorted(r.date_key for r in differing.select("date_key").distinct().collect())
        else:
            wh.add(staging.reject_rows(differing, number, "differs_from_stored"), REJECTS, number)
        changed = warehouse.co_locate(changed if anew else changed.filter("NOT known"), buckets)
        rows = facts.corrected(changed, fact, anew) if anew else changed.drop("known")
    # Keys are assigned after all shuffles, in the tasks that write them.
    rows = facts.with_surrogate_keys(rows, "sub_key", base.top_sub_key)
    now = F.current_timestamp()
    rows = rows.withColumn("loaded_at", F.coalesce("loaded_at", now) if anew else now)
    written = wh.add(rows.select(*S.FACT.fieldNames()), FACT, number, buckets)
    step(FACT)

    # Counted from what was written: counters inside a retried stage may count twice.
    counts = (
        written.groupBy("date_key", "region")
        .agg(
            F.count("*").alias("rows"),
            F.max("sub_key").alias("top"),
            F.count_if(F.col("sub_key") > base.top_sub_key).alias("loaded"),
        )
        .collect()
    )
    state = _with_rows(state, base, counts, anew, number)
    state = write_marts(wh, before, wh.bound(state), written, number, plans, anew, step)
    refused = wh.bound(state).get(REJECTS)
    rejected = refused and refused.filter(F.col("load_id") == number).agg(F.sum("copies")).first()[0]
    step("publication")
    wh.publish(state)
    # The staging rows before these stay for readers of the publication before.
    wh.drop_loads([n for n in base.loads if n < base.staging], (STAGING,))
    return sum(r.loaded for r in counts), rejected or 0


def _grow_calendar(wh, before, number, calendar):
    known = before.get(CALENDAR)
    first = known is None or not before.published().loads
    if first or calendar:
        span = seeds.calendar(wh.spark, *(calendar or (S.CALENDAR_FIRST, S.CALENDAR_LAST)))
        more = span if first else span.join(known.select("date_key"), "date_key", "left_anti")
        if not more.isEmpty():
            wh.add(more.coalesce(1), CALENDAR, number)


def _with_rows(state, base, counts, anew, number):
    """The state with the rows that a load wrote, by month and region."""
    rows = {m: dict(found) for m, found in base.rows.items() if date.fromisoformat(m) not in anew}
    for r in counts:
        of = rows.setdefault(_iso(r.date_key), {})
        of[r.region] = of.get(r.region, 0) + r.rows
    return replace(
        state,
        rows=rows,
        since=state.since | {_iso(m): number for m in anew},
        top_sub_key=max([base.top_sub_key, *[r.top for r in counts]]),
    )


def write_marts(wh, before, own, written, number, plans, anew, step):
    """Stores the mart rows of the months that a load touched; returns the state that has them."""
    state, base, buckets = own.published(), before.published(), wh.layout()
    touched = sorted({*[m for m in state.rows if state.rows[m] != base.rows.get(m)], *map(_iso, anew)})
    fact = own.read(FACT)

    def of(months):
        return fact.filter(F.col("date_key").isin([date.fromisoformat(m) for m in months]))

    shown = {m for m in (state.newest(), observed_month(state)) if m}
    stale = sorted(m for m in shown if m in touched or m not in base.boards)

    def cells():
        if touched:
            wh.add(marts.cells(of(touched), own.read(CUSTOMERS), plans), CELLS, number)

    def bits():
        if touched:
            wh.add(marts.customer_bits(of(touched), own.read(CUSTOMERS), plans), BITS, number)

    def at_risk():
        if stale:
            wh.add(marts.at_risk_rows(of(stale), own.read(CUSTOMERS), plans), AT_RISK, number)

    def cohorts():
        """The months whose cohorts were written."""
        if not touched:
            return []
        wh.add(marts.customer_months(fact if anew else written), CUSTOMER_MONTHS, number, buckets)
        # A corrected row may have left a region: what was merged can't tell, the fact can.
        merged = wh.bound(replace(state, months_since=number) if anew else state).read(CUSTOMER_MONTHS)
        moved = _first_moved(before.get(CUSTOMER_MONTHS), merged) if base.loads else None
        again = touched if moved is None else [m for m in state.rows if m in touched or m >= moved]
        wh.add(marts.cohort_cells(of(again), merged), COHORTS, number)
        return again

    *_, again = together(cells, bits, at_risk, cohorts)
    for name in (CELLS, BITS, COHORTS, AT_RISK):
        step(name)
    return replace(
        state,
        months_since=number if anew else state.months_since,
        cells=state.cells | dict.fromkeys(touched, number),
        cohorts=state.cohorts | dict.fromkeys(again, number),
        boards={m: number if m in stale else base.boards[m] for m in sorted(shown)},
    )


def _first_moved(old: DataFrame, new: DataFrame) -> str | None:
    """The earliest month from which a customer's cohort is another one than before; None if all stand."""
    earliest = []
    for was, now in zip(marts.first_months(old), marts.first_months(new)):
        *keys, first = was.columns
        both = was.withColumnRenamed(first, "was").join(now.withColumnRenamed(first, "now"), keys, "left")
        differs = both.filter(~F.col("was").eqNullSafe(F.col("now")))
        earliest.append(differs.agg(F.min(F.least("was", F.coalesce("now", "was")))).first()[0])
    found = [m for m in earliest if m is not None]
    return min(found).isoformat() if found else None


def run(
    wh,
    stg: DataFrame,
    run_by="scheduler",
    calendar=None,
    plans=None,
    input_bytes=0,
    account_grain=False,
    correct=False,
    at=None,
    step=None,
) -> LoadResult:
    """Loads a staging frame.

    ``calendar``, a pair of months, grows the stored calendar with the load;
    rows of other months are refused. ``account_grain`` is the caller's word that
    the rows carry the source's own ``customer_key``, hashed by it, at most one
    per account and month. ``correct`` lets rows that differ from stored ones replace them.
    ``at`` is the time that the log gives the run, ``step`` is called with the name of
    each thing that is about to stand.
    """
    started = time.monotonic()
    number = wh.claim()
    try:
        with load_settings(wh.spark, input_bytes, wh.layout() or wh.buckets):
            loaded, rejected = _load(wh, number, stg, calendar, plans, account_grain, correct, step or (lambda name: None))
    except Exception as e:
        # Written on its own, so it stays although the load did not.
        write_audit(wh, number, run_by, "FAILED", error=str(e), started=started, at=at)
        raise
    status = "PARTIAL" if rejected else "SUCCESS"
    write_audit(wh, number, run_by, status, loaded, rejected, started=started, at=at)
    return LoadResult(loaded, rejected, status)


def purge_log(wh, as_of=None, days=S.LOG_RETENTION_DAYS) -> list[str]:
    """Deletes the days of the log that have expired as a whole; part of the scheduled refresh."""
    as_of = F.current_timestamp() if as_of is None else as_of
    last = wh.spark.range(1).select(F.to_date(as_of - F.make_dt_interval(F.lit(days)))).first()[0]
    return wh.drop_log_days(last)


def compact(wh) -> None:
    """Writes all tables anew under one load id, after many small loads, and drops the old files.

    Published like a load: readers see the old files or the new ones. Readers that still hold
    the publication before lose their files, so it belongs where nobody reads.
    """
    base = wh.published()
    before = wh.bound(base)
    number, buckets = wh.claim(), wh.layout()
    with load_settings(wh.spark, 0, buckets):
        for table in warehouse.LOADED:
            df = before.get(table)
            if df is None:
                continue
            keyed = table in warehouse.SORT_KEYS and "customer_key" in df.columns
            if table == CUSTOMER_MONTHS:
                df = marts.customer_months(before.read(FACT))
            if table in warehouse.MARTS or table in (CALENDAR, REJECTS):
                df = df.coalesce(1) if table != AT_RISK else df
            elif keyed:
                # Read bucket by bucket, so rows are hashed already and one task writes a bucket's files.
                df = warehouse.co_locate(df, buckets)
            wh.add(df, table, number, buckets if keyed else 0)
    one = replace(
        base,
        loads=(number,),
        staging=number,
        since={},
        months_since=0,
        **{name: dict.fromkeys(getattr(base, name), number) for name in ("cells", "cohorts", "boards")},
    )
    wh.publish(one)
    wh.drop_loads(base.loads)


def verify(wh) -> tuple[DataFrame, DataFrame]:
    """Row counts of the six tables and the newest log row."""
    wh = wh.bound()
    counts = audit.table_counts(
        {
            "dim_customer": wh.read(CUSTOMERS),
            "dim_plan": seeds.plans(wh.spark),
            "dim_date": wh.read(CALENDAR),
            "fact_subscriptions": wh.read(FACT),
            "stg_subscriptions": wh.read(STAGING),
            "refresh_log": wh.read(LOG),
        }
    )
    return counts, audit.latest(wh.read(LOG))


def main(argv=None):
    from tidemark.session import builder

    p = argparse.ArgumentParser(description="Load a staging CSV into the warehouse")
    p.add_argument("--csv", required=True)
    p.add_argument("--warehouse", required=True)
    p.add_argument("--buckets", type=int)
    p.add_argument("--first-month")
    p.add_argument("--last-month")
    p.add_argument("--run-by", default="scheduler")
    args = p.parse_args(argv)
    spark = builder("tidemark-load").getOrCreate()
    wh = warehouse.Warehouse(spark, args.warehouse, args.buckets)
    calendar = (args.first_month, args.last_month) if args.first_month and args.last_month else None
    stg = staging.read_csv(spark, args.csv)
    result = run(wh, stg, args.run_by, calendar, input_bytes=warehouse.planned_bytes(stg))
    counts, newest = verify(wh)
    print(result)
    counts.show(truncate=False)
    newest.show(truncate=False)


if __name__ == "__main__":
    main()
