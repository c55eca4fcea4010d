"""Stored tables: where they live, how they are laid out, and which loads count.

``fact_subscriptions`` is partitioned by load and month and, like ``dim_customer`` and the
customers' months, bucketed by ``customer_key`` into the same number of buckets:

* joins, distinct counts and aggregations keyed by customer need no shuffle;
* a filter on months opens the files of those months only.

A customer has one row a month, which the load enforces, so no bucket can grow
hot: its size is a number of customers times a number of months. Staging is
bucketed the same way where its rows carry the key already; the load then builds
dimension and fact from it without a shuffle.

Whatever a load writes, marts included, goes into partitions of its load id, which nobody
reads until one small file, the pointer, names the load. Readers take the pointer once
and see all tables as of that publication; a load that fails leaves files that no pointer
names. A load id is claimed by creating a file, and a pointer follows the one its load
began from, so two loads at once cannot both be published. The log alone is
written outside of this, since it also tells of loads that failed.
"""

import hashlib
import json
import math
from copy import copy
from dataclasses import asdict, dataclass, field, replace
from datetime import date

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidemark import schemas as S
from tidemark.sources import seeds

FACT = "fact_subscriptions"
CUSTOMERS = "dim_customer"
CUSTOMER_MONTHS = "customer_months"
CALENDAR = "dim_date"
STAGING = "stg_subscriptions"
THRESHOLDS = "alert_thresholds"
POLICY = "rls_region_policy"
LOG = "refresh_log"
REJECTS = "stg_rejects"
CELLS, COHORTS, AT_RISK, BITS = MARTS = ("mart_cells", "mart_cohorts", "mart_at_risk", "mart_customer_bits")

AREAS = {
    **dict.fromkeys((FACT, CUSTOMERS, CUSTOMER_MONTHS, CALENDAR, STAGING, THRESHOLDS, POLICY), "core"),
    **dict.fromkeys((LOG, REJECTS), "audit"),
    **dict.fromkeys(MARTS, "mart"),
}
SORT_KEYS = {FACT: "customer_key", CUSTOMERS: "customer_key", CUSTOMER_MONTHS: "customer_key", STAGING: "customer_key"}
# Partitions below the load's.
PARTITIONS = {FACT: ["date_key"], CELLS: ["region"], COHORTS: ["region"], AT_RISK: ["last_active_month", "seen_in"], BITS: ["region"]}
# Tables of which each load writes a part.
LOADED = (FACT, CUSTOMERS, CUSTOMER_MONTHS, CALENDAR, STAGING, REJECTS, *MARTS)
LOAD = "load_id"
PARTITION_TYPES = {LOAD: "int", "date_key": "date", "last_active_month": "date", "region": "string", "seen_in": "string"}
# Small tables without loads: changed by whoever runs the warehouse.
SWAPPED = {
    THRESHOLDS: f"{S.THRESHOLD_COLUMNS}, last_updated_by STRING, last_updated_at TIMESTAMP",
    POLICY: S.POLICY_COLUMNS,
}
LAYOUT = T.StructType([T.StructField("buckets", T.IntegerType())])
LOG_DAY = "day"

# Input per bucket. Facts are a few percent of the order data they come from, over
# some 80 months: a file of one bucket and month has about 128 MB.
BUCKET_BYTES = 320 << 30
# Account-months per bucket at most, where their number is known. A bucket is written, sorted and
# joined by one task, which holds some 500 bytes a row.
BUCKET_ROWS = 1 << 20


def bucket_count(input_bytes: int, rows: int = 0) -> int:
    """Buckets of about ``BUCKET_BYTES`` of input and ``BUCKET_ROWS`` rows: one for what is small."""
    return max(1, math.ceil(input_bytes / BUCKET_BYTES), math.ceil(rows / BUCKET_ROWS))


def planned_bytes(df: DataFrame) -> int:
    """Size of a frame's input as the optimizer knows it from the file listing; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def listing(spark, paths) -> tuple:
    """Names, sizes and times of the files under paths: equal listings mean equal input."""
    found = []
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def co_locate(df: DataFrame, buckets: int) -> DataFrame:
    """Hashes rows the way bucket files are."""
    return df.repartition(buckets, "customer_key")


@dataclass(frozen=True)
class Published:
    """What readers see: the loads that count, and which of them says what about a month.

    Months are ISO dates. The whole thing is a few numbers a month and load.
    """

    version: int = 0
    loads: tuple = ()
    # Load whose staging rows stand; staging is a full refresh.
    staging: int = 0
    # First load that counts for a month, where a load wrote the month anew.
    since: dict = field(default_factory=dict)
    # First load whose customer months count, where a load wrote them anew.
    months_since: int = 0
    # Month -> load whose mart rows stand.
    cells: dict = field(default_factory=dict)
    cohorts: dict = field(default_factory=dict)
    boards: dict = field(default_factory=dict)
    # Month -> region -> rows of the fact.
    rows: dict = field(default_factory=dict)
    top_sub_key: int = 0
    top_customer_key: int = 0

    def newest(self, regions=None) -> str | None:
        """The newest month with rows, in some of the regions where they are given."""
        seen = [m for m, found in self.rows.items() if regions is None or set(found) & set(regions)]
        return max(seen, default=None)

    def standing(self, table: str):
        """The rows of a table that count, as a condition on its partitions."""
        load = F.col(LOAD)
        if table == STAGING:
            return load == self.staging
        counted = load.isin(list(self.loads)) if self.loads else F.lit(False)
        if table == CUSTOMER_MONTHS:
            return counted & (load >= self.months_since)
        if table == FACT and self.since:
            month = F.col("date_key")
            anew = F.lit(False)
            for at, first in self.since.items():
                anew = anew | ((month == F.lit(date.fromisoformat(at))) & (load >= first))
            return counted & (~month.isin([date.fromisoformat(at) for at in self.since]) | anew)
        if table in MARTS and len(self.loads) > 1:
            of, column = {
                CELLS: (self.cells, "month"),
                BITS: (self.cells, "month"),
                COHORTS: (self.cohorts, "month"),
                AT_RISK: (self.boards, "last_active_month"),
            }[table]
            loads = {}
            for at, number in of.items():
                loads.setdefault(number, []).append(date.fromisoformat(at))
            stands = F.lit(False)
            for number, months in loads.items():
                stands = stands | ((load == number) & F.col(column).isin(months))
            return stands
        return counted


class Superseded(RuntimeError):
    """Another load was published after this one began."""


# Root -> newest publication whose partitions this application's catalog holds.
_catalogued: dict[str, int] = {}


class Warehouse:
    """Tables under one root folder on shared storage.

    ``buckets`` is the layout asked for; ``fix_layout`` records the one used,
    which later loads and applications then keep.
    """

    def __init__(self, spark, root: str, buckets: int | None = None):
        self.spark = spark
        self.root = str(root).rstrip("/")
        self.buckets = buckets or 1
        self._state = None

    @classmethod
    def sized_for(cls, spark, root: str, input_bytes: int, rows: int = 0) -> "Warehouse":
        return cls(spark, root, bucket_count(input_bytes, rows))

    def path(self, table: str) -> str:
        return f"{self.root}/{AREAS[table]}/{table}"

    def _name(self, table: str) -> str:
        # Catalog names are per root, so several warehouses share a session.
        return f"tidemark_{hashlib.sha256(self.root.encode()).hexdigest()[:12]}_{table}"

    def layout(self) -> int | None:
        """Buckets of the keyed tables; None before the first load."""
        try:
            row = self.spark.read.schema(LAYOUT).parquet(f"{self.root}/audit/layout").first()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return row and row["buckets"]

    def fix_layout(self, buckets: int) -> int:
        one = self.spark.range(1).select(F.lit(buckets).alias("buckets"))
        one.write.mode("overwrite").parquet(f"{self.root}/audit/layout")
        return buckets

    # ---- publication ----------------------------------------------------------

    def _folders(self, *paths):
        """(file system, Hadoop paths)."""
        made = [self.spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
        return made[0].getFileSystem(self.spark._jsc.hadoopConfiguration()), made

    def _numbers(self, folder: str) -> list[int]:
        """The numbers that name files of a folder."""
        fs, (at,) = self._folders(f"{self.root}/{folder}")
        if not fs.exists(at):
            return []
        names = [f.getPath().getName().split(".")[0] for f in fs.listStatus(at)]
        return sorted(int(n) for n in names if n.isdigit())

    def published(self, version: int | None = None) -> Published:
        """The publication this warehouse is bound to, else the newest one, or an earlier one by its number."""
        if self._state is not None:
            return self._state
        versions = self._numbers("published") if version is None else [version]
        if not versions:
            return Published()
        fs, (at,) = self._folders(f"{self.root}/published/{versions[-1]:08d}.json")
        stream = fs.open(at)
        try:
            return Published(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def bound(self, state: Published | None = None) -> "Warehouse":
        """The same tables as of one publication, whatever is published later."""
        one = copy(self)
        one._state = self.published() if state is None else state
        return one

    def claim(self) -> int:
        """A load id that no other load has: its file did not exist before."""
        number = max([0, *self._numbers("claims")])
        while True:
            number += 1
            fs, (at,) = self._folders(f"{self.root}/claims/{number:08d}")
            if fs.createNewFile(at):
                return number

    def publish(self, state: Published) -> Published:
        """Makes a state the newest one, if none was published since the one it comes from.

        The file is written beside, and appears under its name at once or, if that
        name is taken, not at all.
        """
        state = replace(state, version=state.version + 1)
        fs, (new, at) = self._folders(*[f"{self.root}/published/{n}" for n in (f".{state.version}.{state.loads[-1]}", f"{state.version:08d}.json")])
        out = fs.create(new, True)
        out.write(bytearray(json.dumps(asdict(state)).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf()).rename(new, at, options)
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Superseded(f"version {state.version} was published by another load meanwhile") from None
            raise
        _catalogued[self.root] = state.version
        return state

    # ---- tables -------------------------------------------------------------

    def _reopen(self, table: str) -> bool:
        """Puts files written by an earlier application into this one's catalog."""
        fs, (now,) = self._folders(self.path(table))
        if not fs.exists(now):
            return False
        try:
            fields = self.spark.read.parquet(self.path(table)).schema
        except AnalysisException as e:
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                return False
            raise
        parted = self._partitions(table)
        kinds = {f.name: f.dataType.simpleString() for f in fields}
        kinds |= {name: PARTITION_TYPES[name] for name in parted}
        columns = ", ".join(f"`{name}` {kind}" for name, kind in kinds.items())
        by = f"PARTITIONED BY ({', '.join(parted)})"
        buckets = self.layout() if table in SORT_KEYS else 0
        if buckets and table == STAGING and "customer_key" not in fields.fieldNames():
            buckets = 0
        clustered = f"CLUSTERED BY (customer_key) SORTED BY ({SORT_KEYS[table]}) INTO {buckets} BUCKETS" if buckets else ""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet "
            f"{by} {clustered} LOCATION '{self.path(table)}'"
        )
        self.spark.catalog.recoverPartitions(self._name(table))
        return True

    @staticmethod
    def _partitions(table: str) -> list[str]:
        return [LOAD, *PARTITIONS.get(table, [])]

    def get(self, table: str) -> DataFrame | None:
        """The rows of a table that count, or None before its first write."""
        if table == LOG:
            return self._log()
        if table in SWAPPED:
            return self._swapped(table)
        state = self.published()
        if state.version > _catalogued.setdefault(self.root, state.version):
            self.forget_listings()
            _catalogued[self.root] = state.version
        name = self._name(table)
        if not (self.spark.catalog.tableExists(name) or self._reopen(table)):
            return None
        df = self.spark.table(name)
        if table in (CUSTOMERS, FACT) and not state.loads:
            return None
        return df.filter(state.standing(table)).drop(*[] if table == REJECTS else [LOAD])

    def _log(self) -> DataFrame | None:
        fs, (at,) = self._folders(self.path(LOG))
        if not fs.exists(at):
            return None
        schema = T.StructType([*S.REFRESH_LOG.fields, T.StructField(LOG_DAY, T.DateType())])
        return self.spark.read.schema(schema).parquet(self.path(LOG)).drop(LOG_DAY)

    def append_log(self, row: DataFrame) -> None:
        by_day = row.withColumn(LOG_DAY, F.to_date("run_ts")).coalesce(1)
        by_day.write.mode("append").partitionBy(LOG_DAY).parquet(self.path(LOG))

    def drop_log_days(self, before: date) -> list[str]:
        """Deletes the folders of whole days; no file of a day that stays is opened."""
        fs, (at,) = self._folders(self.path(LOG))
        gone = []
        if fs.exists(at):
            for f in fs.listStatus(at):
                name = f.getPath().getName()
                if name.startswith(f"{LOG_DAY}=") and date.fromisoformat(name[len(LOG_DAY) + 1 :]) < before:
                    fs.delete(f.getPath(), True)
                    gone.append(name)
        return gone

    def forget_listings(self) -> None:
        """Looks anew for what another session or application wrote."""
        for table in LOADED:
            name = self._name(table)
            if self.spark.catalog.tableExists(name):
                self.spark.catalog.recoverPartitions(name)
                self.spark.catalog.refreshTable(name)

    def read(self, table: str) -> DataFrame:
        df = self.get(table)
        if df is None:
            raise LookupError(f"{table} has not been loaded under {self.root}")
        return df

    def add(self, df: DataFrame, table: str, load_id: int, buckets: int = 0) -> DataFrame:
        """Writes a load's part of a table and returns it; nobody else sees it before it is published.

        For buckets, ``df`` is hashed by ``co_locate`` or read from such a table.
        """
        name = self._name(table)
        if not self.spark.catalog.tableExists(name):
            self._reopen(table)
        own = df.drop(LOAD).withColumn(LOAD, F.lit(load_id).cast("int"))
        writer = own.write.mode("append").partitionBy(*self._partitions(table))
        if buckets:
            writer = writer.bucketBy(buckets, "customer_key").sortBy(SORT_KEYS[table])
        writer.option("path", self.path(table)).format("parquet").saveAsTable(name)
        return self.spark.table(name).filter(F.col(LOAD) == load_id).drop(LOAD)

    def replace(self, df: DataFrame, table: str) -> DataFrame:
        """Swaps in a small table written beside the old one; ``df`` may read the old one."""
        fs, (now, new, old) = self._folders(self.path(table), f"{self.path(table)}.next", f"{self.path(table)}.old")
        df.coalesce(1).write.mode("overwrite").parquet(new.toString())
        if fs.exists(now):
            fs.delete(old, True)
            fs.rename(now, old)
        fs.rename(new, now)
        fs.delete(old, True)
        return self.read(table)

    def _swapped(self, table: str) -> DataFrame | None:
        """A small table that is replaced as a whole."""
        fs, (now, old) = self._folders(self.path(table), f"{self.path(table)}.old")
        if not fs.exists(now):
            if not fs.exists(old):
                return None
            fs.rename(old, now)  # a driver was lost in the middle of a swap
        return self.spark.read.schema(SWAPPED[table]).parquet(self.path(table))

    def scratch(self, df: DataFrame, name: str) -> DataFrame:
        """A written intermediate: cuts lineage and fixes non-deterministic columns."""
        path = f"{self.root}/scratch/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_loads(self, loads, tables=LOADED) -> None:
        """Deletes the files of loads that no publication in use names."""
        for table in tables:
            fs, (at,) = self._folders(self.path(table))
            for f in fs.listStatus(at) if loads and fs.exists(at) else ():
                key, _, number = f.getPath().getName().partition("=")
                if key == LOAD and int(number) in loads:
                    fs.delete(f.getPath(), True)
                    if self.spark.catalog.tableExists(self._name(table)):
                        self.spark.sql(f"ALTER TABLE {self._name(table)} DROP IF EXISTS PARTITION ({LOAD}={number})")

    # ---- domains --------------------------------------------------------------

    def prepare(self) -> None:
        """Seeds the thresholds and the policy of a new warehouse."""
        for table, seed in ((THRESHOLDS, seeds.thresholds), (POLICY, seeds.region_policy)):
            if self.get(table) is None:
                self.replace(seed(self.spark), table)

    def set_threshold(self, metric: str, by: str, **values) -> None:
        """Changes warning_threshold, critical_threshold, direction or enabled of a metric, and says who did."""
        known = {"warning_threshold", "critical_threshold", "direction", "enabled"}
        if not values or set(values) - known:
            raise ValueError(f"expected some of {sorted(known)}, got {sorted(values)}")
        if values.get("direction", "ABOVE") not in ("ABOVE", "BELOW"):
            raise ValueError("direction is ABOVE or BELOW")
        old = self.read(THRESHOLDS)
        if old.filter(F.col("metric_name") == metric).isEmpty():
            raise LookupError(f"no threshold for {metric!r}")
        mine = F.col("metric_name") == metric
        changed = values | {"last_updated_by": by, "last_updated_at": F.current_timestamp()}
        kinds = dict(old.dtypes)
        new = {c: F.when(mine, F.lit(v).cast(kinds[c])).otherwise(F.col(c)) for c, v in changed.items()}
        self.replace(old.withColumns(new), THRESHOLDS)

    def set_policy(self, user: str, regions) -> None:
        """Makes `regions` the ones that a user may see; none of them for an empty list."""
        rest = self.read(POLICY).filter(F.col("db_user") != user)
        rows = [(user, region) for region in sorted(set(regions))]
        given = self.spark.createDataFrame(rows, rest.schema)
        self.replace(rest.unionByName(given), POLICY)

    def regions_of(self, user: str) -> list[str]:
        """The regions a user may see; the policy has a few rows a user."""
        return [r.region for r in self.read(POLICY).filter(F.col("db_user") == user).collect()]
