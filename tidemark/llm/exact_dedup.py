"""Exact deduplication over sharded cuckoo-filter indexes.

A shard holds the live digests whose leading bits fall to it: a cuckoo filter
of 16-bit fingerprints answers most lookups, and a hit is believed only after
the full SHA-256 digest is found in the shard's stored content. Entries can be
deleted as well as inserted; when an insertion finds no free slot the filter is
rebuilt at twice the size from the stored keys. `deduplicate` runs it over a
table, `update_index` carries a stored index from batch to batch.

Cases: a null text counts as empty, and empty texts equal each other; a null id
ranks below every other id and stays only if all ids of its text are null; rows
that agree in id and text are the same document and share its verdict; a text of
any length is hashed whole; an empty table gives an empty result. Only the id
and text columns are read, so further columns of any name do no harm.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 4
#: Relocations tried before the filter is rebuilt larger.
KICKS = 200
#: Partial groups per digest that reach the index, so that a text which makes up
#: a third of all rows arrives as a few pre-aggregated rows.
SALTS = 8


class CuckooFilter:
    """Fingerprints in buckets of four slots; an item's two buckets differ by a hash of its fingerprint."""

    def __init__(self, buckets: int = 64):
        self.mask = buckets - 1
        self.slots = [[] for _ in range(buckets)]
        self.size = 0

    def _places(self, digest: bytes):
        mark = int.from_bytes(digest[-2:], "big") or 1
        first = int.from_bytes(digest[-10:-2], "big") & self.mask
        return mark, first, first ^ self._step(mark)

    def _step(self, mark: int) -> int:
        return (mark * 0x5BD1E995 >> 7) & self.mask

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.slots[a] or mark in self.slots[b]

    def insert(self, digest: bytes) -> bool:
        """False if no slot came free; a fingerprint was then displaced and the filter must be rebuilt."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(mark)
                self.size += 1
                return True
        at = a
        for turn in range(KICKS):
            slot = self.slots[at]
            victim = turn % SLOTS
            slot[victim], mark = mark, slot[victim]
            at ^= self._step(mark)
            if len(self.slots[at]) < SLOTS:
                self.slots[at].append(mark)
                self.size += 1
                return True
        return False

    def delete(self, digest: bytes) -> None:
        """Only for a digest that was inserted; else another one's fingerprint might go."""
        mark, a, b = self._places(digest)
        for at in (a, b):
            if mark in self.slots[at]:
                self.slots[at].remove(mark)
                self.size -= 1
                return


class CuckooIndex:
    """A filter before stored content: digest -> [doc_id that stays, rows]."""

    def __init__(self, buckets: int = 64):
        self.filter = CuckooFilter(buckets)
        self.content: dict[bytes, list] = {}
        self.lookups = self.false_hits = self.resizes = 0

    def find(self, digest: bytes):
        """The live entry of a digest; content is consulted only when the filter hits."""
        self.lookups += 1
        if digest not in self.filter:
            return None
        entry = self.content.get(digest)
        self.false_hits += entry is None
        return entry

    def add(self, digest: bytes, doc_id, rows: int = 1) -> None:
        entry = self.find(digest)
        if entry is None:
            self.content[digest] = [doc_id, rows]
            if not self.filter.insert(digest):
                self._resize()
            return
        entry[1] += rows
        if entry[0] is None or (doc_id is not None and doc_id > entry[0]):
            entry[0] = doc_id

    def remove(self, digest: bytes) -> bool:
        """Forget a live digest; False if it isn't there."""
        if self.find(digest) is None:
            return False
        del self.content[digest]
        self.filter.delete(digest)
        return True

    def _resize(self) -> None:
        buckets = 2 * (self.filter.mask + 1)
        while True:
            self.resizes += 1
            self.filter = CuckooFilter(buckets)
            if all(map(self.filter.insert, self.content)):
                return
            buckets *= 2


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, sha) rows: the SHA-256 of the whole text's UTF-8, in hex."""
    return docs.select(
        F.col(key).alias("key"),
        F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha"),
    )


def _index_shard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for frame in frames:
        ids = frame["id"].astype("object").where(frame["id"].notna(), None)
        for sha, doc_id, rows in zip(frame["digest"], ids, frame["n"]):
            index.add(bytes(sha), None if doc_id is None else int(doc_id), int(rows))
    entries = list(index.content.items())
    for at in range(0, len(entries), 50_000):
        part = entries[at : at + 50_000]
        yield pd.DataFrame(
            {
                "sha": [d.hex() for d, _ in part],
                "keep_id": pd.array([e[0] for _, e in part], dtype="Int64"),
                "group_size": np.array([e[1] for _, e in part], dtype="int64"),
            }
        )


def index_of(rows: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size): one row per live digest, from (key, sha) rows.

    Copies are merged by Spark's map-side aggregation first, into at most SALTS
    rows a digest; digests are uniform, so shards are even whatever the copies.
    """
    partial = rows.groupBy("sha", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).agg(
        F.max("key").cast("long").alias("id"), F.count("*").alias("n")
    )
    return (
        partial.select(F.unhex("sha").alias("digest"), "id", "n")
        .repartition(F.substring("digest", 1, 4))
        .mapInPandas(_index_shard, "sha string, keep_id long, group_size long")
    )


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of docs.

    The join back is on the digest; adaptive skew handling splits a digest that
    many rows share. Only ids and digests are shuffled, never texts.
    """
    rows = digests(docs, key, text)
    return rows.join(index_of(rows), "sha").select(
        F.col("key").alias(key),
        "keep_id",
        "group_size",
        F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def update_index(index: DataFrame, changes: DataFrame) -> DataFrame:
    """The index after a batch of changes.

    index: (sha, keep_id, group_size). changes: (sha, doc_id, change) with change
    ``add`` or ``remove``; removals come first, each takes a whole digest out, and
    removing an absent digest does nothing. Both sides are co-partitioned by the
    digest's leading bits, and additions are merged before the shuffle.
    """
    merged = changes.groupBy("sha", "change").agg(F.max("doc_id").alias("id"), F.count("*").alias("n"))
    live = index.select("sha", F.lit("live").alias("change"), F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
    ranked = live.unionByName(merged).withColumn(
        "turn", F.when(F.col("change") == "live", 0).when(F.col("change") == "remove", 1).otherwise(2)
    )

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = CuckooIndex()
        for frame in frames:
            for sha, doc_id, rows, turn in zip(frame["sha"], frame["id"], frame["n"], frame["turn"]):
                if turn == 1:
                    shard.remove(bytes.fromhex(sha))
                else:
                    shard.add(bytes.fromhex(sha), None if pd.isna(doc_id) else int(doc_id), int(rows))
        entries = list(shard.content.items())
        yield pd.DataFrame(
            {
                "sha": [d.hex() for d, _ in entries],
                "keep_id": pd.array([e[0] for _, e in entries], dtype="Int64"),
                "group_size": np.array([e[1] for _, e in entries], dtype="int64"),
            }
        )

    return (
        ranked.repartition(F.substring("sha", 1, 8))
        .sortWithinPartitions("turn")
        .mapInPandas(apply, "sha string, keep_id long, group_size long")
    )


def digest_of(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode()).digest()
