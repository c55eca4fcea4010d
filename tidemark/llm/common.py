"""Helpers the operators share: tables, hold-out split, words, stored intermediates."""

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes 0x30-0x39, 0x61-0x7A and 0x80-0xFF form words after A-Z are lower-cased;
#: every other byte separates them. In UTF-8 that is the contract's character class.
_FOLD = bytearray(b" " * 256)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _FOLD[_b] = _b
for _b in range(0x41, 0x5B):
    _FOLD[_b] = _b + 32
FOLD = bytes(_FOLD)


#: Rows and bytes of text that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 2000, "8m"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark):
    """Let Python workers import this package from where the driver found it.

    Enough wherever that folder is readable (one machine, a shared mount); elsewhere
    submit the package with --py-files, as for any PySpark job. Arrow batches are
    bounded as well, because a task holds a few of them beside what it computes.
    """
    if int(spark.conf.get(_BATCH_ROWS)) > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    spark.conf.set(_BATCH_BYTES, BATCH_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))
    return spark


def table(spark, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text is divisible by 5; a null id is not held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 5
    return F.coalesce(rest == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: those with an id that is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id)


def folded(text: str | None) -> bytes:
    """Text as UTF-8 in which word bytes are lower-cased and all others are spaces."""
    return (text or "").encode("utf-8", "replace").translate(FOLD)


def shared_folder(spark) -> str:
    """A new folder below the one that driver and executors share.

    A local session without ``spark.checkpoint.dir`` (a test) gets its warehouse folder;
    on a cluster the setting is needed, as that folder may be a machine's own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidemark-llm/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
