"""Best-fit-decreasing packing of token sequences, exact over the whole corpus.

Documents become ids of a byte-level BPE vocabulary plus an end id. Longer ones
are cut into full pieces; the remainder, if any, is the first piece. Pieces of
one length are interchangeable, so best-fit decreasing over the corpus depends
only on how many pieces there are of each length: a histogram of at most
`capacity` numbers. The driver runs best-fit decreasing on that histogram with a
segment tree over remaining capacities, moving whole ranges of equal bins at
once, which yields a short list of moves whose size depends on the capacity and
not on the corpus. Each piece then finds its bin from its rank among pieces of
its length; ranks come from counts per (bucket, length) and a window inside
each bucket. The result is the packing that a single global best-fit-decreasing
run would give, with no task holding more than a bucket.

Cases: a null or empty text is one piece holding just the end id; a null id is
packed like any other; repeated rows are packed once each; ties among pieces of
equal length go by id, then piece; a text of any length is tokenised whole; an
empty table packs into nothing. Only the id and text columns are read.
"""

import base64
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored

CAPACITY = 1024
END_ID = 2
#: Pieces per bucket in which ranks are counted.
BUCKET_PIECES = 2048

_PIECE = "array<struct<piece: int, start: long, length: long, ids_crc32: long, ids: array<int>>>"
_encoders: dict[str, object] = {}


def encoder(json_path: str | None = None):
    """text -> ids of the vocabulary file, special tokens treated as the file says.

    The rank file beside the vocabulary holds the same merges and encodes several
    times faster, so it does the work where it exists; a text that spells out a
    special token goes to the vocabulary's own tokenizer.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    if json_path not in _encoders:
        whole = Tokenizer.from_file(json_path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        try:
            import tiktoken

            with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary
        except (ImportError, FileNotFoundError):
            fast = None

        def encode(text: str) -> list[int]:
            if fast is None or any(s in text for s in special):
                return whole.encode(text, add_special_tokens=False).ids
            return fast(text)

        _encoders[json_path] = encode
    return _encoders[json_path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, after the remainder if there is one."""
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every document."""

    @F.pandas_udf(_PIECE)
    def tokenise(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(tokenizer)
        for part in texts:
            rows = []
            for t in part:
                ids = array("I", encode(t or ""))
                ids.append(end_id)
                if sys.byteorder != "little":
                    ids.byteswap()
                raw = memoryview(ids).cast("B")
                rows.append(
                    [
                        {
                            "piece": k,
                            "start": at,
                            "length": n,
                            "ids_crc32": zlib.crc32(raw[4 * at : 4 * (at + n)]),
                            "ids": ids[at : at + n].tolist() if with_ids else None,
                        }
                        for k, (at, n) in enumerate(cut(len(ids), capacity))
                    ]
                )
            yield pd.Series(rows)

    cut_up = docs.select(F.col(key).alias("key"), F.explode(tokenise(F.col(text))).alias("p"))
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return cut_up.select(F.col("key").alias(key), *[F.col(f"p.{n}").alias(n) for n in names])


class CapacityTree:
    """A segment tree over remaining capacities 0..n: which of them have open bins."""

    def __init__(self, n: int):
        self.leaves = 1 << n.bit_length()
        self.some = [False] * (2 * self.leaves)

    def mark(self, at: int, some: bool) -> None:
        at += self.leaves
        self.some[at] = some
        while at > 1:
            at >>= 1
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest marked capacity that is at least `least`."""
        at = least + self.leaves
        if at >= 2 * self.leaves:
            return None
        if self.some[at]:
            return least
        while at > 1 and (at & 1 or not self.some[at + 1]):
            at >>= 1
        if at <= 1:
            return None
        at += 1
        while at < self.leaves:
            at = 2 * at if self.some[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over a histogram of lengths.

    Returns moves (length, first rank, pieces per bin, bins, first bin, offset)
    and the number of bins: pieces of that length with ranks from `first rank` on
    go, `pieces per bin` together, into consecutive bins from `first bin`, the
    first of a bin at `offset`.
    """
    tree = CapacityTree(capacity)
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    moves, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            open_bins[room].append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                # New bins; the tightest bin for the next piece is always the one just begun.
                room, per = capacity, capacity // length
                first, n = bins, -(-left // per)
                bins += n
            else:
                first, n = open_bins[room].pop()
                tree.mark(room, bool(open_bins[room]))
                per = room // length
            full = min(n, left // per)
            if full:
                moves.append((length, rank, per, full, first, capacity - room))
                put(room - per * length, first, full)
                rank += per * full
                left -= per * full
            if full < n and 0 < left < per:
                moves.append((length, rank, left, 1, first + full, capacity - room))
                put(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(room, first + full, n - full)
    return np.array(moves, dtype=np.int64).reshape(-1, 6), bins


def _placer(moves):
    """(length, rank) columns -> (sequence_id, offset), by the broadcast moves."""

    @F.pandas_udf("sequence_id long, offset long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = moves.value
        scale = np.int64(1) << np.int64(50)
        order = np.lexsort((table[:, 1], table[:, 0]))
        table = table[order]
        starts = table[:, 0] * scale + table[:, 1]
        for length, rank in parts:
            row = table[np.searchsorted(starts, length.to_numpy() * scale + rank.to_numpy(), side="right") - 1]
            nth = rank.to_numpy() - row[:, 1]
            yield pd.DataFrame(
                {
                    "sequence_id": row[:, 4] + nth // row[:, 2],
                    "offset": row[:, 5] + nth % row[:, 2] * row[:, 0],
                }
            )

    return place


def pack(cut_up: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """cut_up (key, piece, length, ...) with sequence_id and offset.

    The pieces are stored once, as the counts and the placing both read them.
    To the driver go the histogram (at most `capacity` rows) and nothing else;
    the moves that come back are bounded by the capacity likewise.
    """
    spark = cut_up.sparkSession
    cut_up = stored(cut_up)
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}
    moves, _ = plan(counts, capacity)
    buckets = max(1, -(-sum(counts.values()) // BUCKET_PIECES))
    dealt = cut_up.withColumn("bucket", F.pmod(F.xxhash64(key, "piece", "start"), F.lit(buckets)))
    per = dealt.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        F.col("bucket"), F.col("length"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )
    order = [key, "piece", "start", *(c for c in ("ids_crc32",) if c in cut_up.columns)]
    ranked = dealt.withColumn(
        "nth", F.row_number().over(Window.partitionBy("bucket", "length").orderBy(*order)) - 1
    )
    where = _placer(spark.sparkContext.broadcast(moves))
    return (
        ranked.join(per, ["bucket", "length"])
        .withColumn("at", where(F.col("length"), F.col("before") + F.col("nth")))
        .select(*cut_up.columns, F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))
    )
