"""Hard negatives by exact integer products, several candidates to a multiplication.

Kronecker packing: components are whole numbers; a bias makes them non-negative, and the
same component of several candidates goes into separate fields of one wide integer. A
field is wide enough for the largest inner product that biased components can have, so
the fields of a sum of products never run into each other: an anchor component is
multiplied once for all of them, and shifts and masks unpack the sums, from which the
bias is taken off exactly. Wide integers of up to 53 bits are held by doubles, in which
BLAS multiplies and adds them without rounding; where products need wider fields they are
Python integers of any width.

Rows are packed into blocks where they lie and written once; anchors are picked from the
blocks into blocks of their own. Every block of anchors meets every block of rows: rows
move once, anchors (a stated query set) to each part of the rows. A first
pass finds each anchor's positives among the rows of its label only, a second one the
negatives below each positive's score. Both keep the best few of a block, and Spark
the best few of those, limited before they are exchanged. No task holds more than a block of
each kind, whatever key or vector is frequent.

Cases: rows with a null label, a null vector, or a component that is null, not finite or
too large to be scaled take no part. A row without an id is never an anchor; as a
candidate it comes after those of equal score with one. Repeated rows are candidates, and
anchors, each by itself. Of vectors of different lengths the shorter one counts (the rest is
zero), so an empty one scores 0. A score beyond 64 bits becomes the nearest long. An empty
table, or one without anchors, gives no rows. Other columns are not read.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

SCALE = 256
#: Components in a block of rows, and of anchors; and products that are held at once.
BLOCK_CELLS, ANCHOR_CELLS, HELD = 1 << 19, 1 << 16, 1 << 20
#: Blocks of rows that share one copy of the anchors where there are many blocks.
BLOCKS_PER_PART = 16
#: Blocks of rows whose anchors one task picks.
BLOCKS_PICKED = 64
#: Bits of a whole number that a double holds exactly, and fields of a Python integer.
DOUBLE_BITS, MANY_FIELDS = 53, 8
LARGEST = (1 << 63) - 2

BLOCK = "block bigint, dims int, ids array<bigint>, labels array<bigint>, anchors array<boolean>, cells binary, narrow boolean"
ANCHORS = "anchor_block bigint, dims int, ids array<bigint>, labels array<bigint>, origin array<struct<block:bigint,at:int>>, cells binary"


# ---- products ---------------------------------------------------------------


def products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products of whole-number rows (as doubles), exact; a row per anchor, as 64-bit integers."""
    dims = min(anchors.shape[1], candidates.shape[1])
    if not dims or not len(anchors) or not len(candidates):
        return np.zeros((len(anchors), len(candidates)), np.int64)
    a, c = anchors[:, :dims], candidates[:, :dims]
    bias_a, bias_c = int(a.min()), int(c.min())
    most = dims * (int(a.max()) - bias_a) * (int(c.max()) - bias_c)
    # So that neither a sum nor what the bias takes off leaves 64 bits.
    largest = dims * max(abs(bias_a), abs(int(a.max()))) * max(abs(bias_c), abs(int(c.max())))
    bits = max(1, most.bit_length())
    if bits > DOUBLE_BITS or max(most, 4 * largest) > LARGEST:
        a, c = _as_python(a), _as_python(c)
        fields = MANY_FIELDS
    else:
        fields = DOUBLE_BITS // bits
    v, u = a - bias_a, c - bias_c
    wide = packed(u, fields, bits)
    sums = v @ wide.T
    if sums.dtype != object:
        sums = sums.astype(np.int64)
    found = np.empty((len(a), wide.shape[0] * fields), sums.dtype)
    for k in range(fields):
        found[:, k::fields] = (sums >> (bits * k)) & ((1 << bits) - 1)
    found = found[:, : len(c)]
    whole = object if sums.dtype == object else np.int64
    off = bias_c * v.sum(axis=1).astype(whole)[:, None] + bias_a * u.sum(axis=1).astype(whole)[None, :]
    found = found + off + dims * bias_a * bias_c
    return np.clip(found, -LARGEST, LARGEST).astype(np.int64)


def _as_python(cells: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in cells.ravel()], object).reshape(cells.shape)


def packed(u: np.ndarray, fields: int, bits: int) -> np.ndarray:
    """Rows of non-negative components, `fields` consecutive ones as fields of one wide row."""
    rows = -(-len(u) // fields)
    wide = np.zeros((rows, u.shape[1]), u.dtype)
    for k in range(fields):
        some = u[k::fields]
        wide[: len(some)] += some * (1 << (bits * k))
    return wide


# ---- blocks -----------------------------------------------------------------


def _matrices(batch):
    """(rows' places, components) for each vector length in a batch."""
    vectors = batch.column("vec")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(lengths)
    with np.errstate(over="ignore"):
        flat = np.floor(SCALE * flat)
    for dims in np.unique(lengths):
        at = np.flatnonzero(lengths == dims)
        cells = flat[(ends[at] - dims)[:, None] + np.arange(dims)]
        fine = np.isfinite(cells).all(axis=1)
        yield at[fine], cells[fine]


def _pack(batches):
    number = TaskContext.get().partitionId() << 32
    waiting, held = {}, 0

    def block(dims):
        nonlocal number
        parts = waiting.pop(dims)
        cells = np.concatenate([p[0] for p in parts])
        narrow = not cells.size or bool(np.abs(cells).max() < 1 << 15)
        columns = [pa.concat_arrays([p[k] for p in parts]) for k in (1, 2, 3)]
        number += 1
        return pa.RecordBatch.from_pylist(
            [
                {
                    "block": number - 1,
                    "dims": dims,
                    "ids": columns[0].to_pylist(),
                    "labels": columns[1].to_pylist(),
                    "anchors": columns[2].to_pylist(),
                    "cells": (cells.astype(np.int16) if narrow else cells).tobytes(),
                    "narrow": narrow,
                }
            ],
            schema=_PACKED,
        )

    for batch in batches:
        for at, cells in _matrices(batch):
            dims = cells.shape[1]
            most = max(1, BLOCK_CELLS // max(1, dims, 16))
            for some in range(0, len(at), most):
                rows = pa.array(at[some : some + most])
                own = cells[some : some + most]
                waiting.setdefault(dims, []).append(
                    (own, *[batch.column(name).take(rows) for name in ("id", "label", "anchor")])
                )
                held += len(own) * max(dims, 16)
                if sum(len(p[0]) for p in waiting[dims]) >= most or held > 4 * BLOCK_CELLS:
                    held -= sum(p[0].shape[0] for p in waiting[dims]) * max(dims, 16)
                    yield block(dims)
    for dims in list(waiting):
        yield block(dims)


_PACKED = pa.schema(
    [
        ("block", pa.int64()),
        ("dims", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.int64())),
        ("anchors", pa.list_(pa.bool_())),
        ("cells", pa.binary()),
        ("narrow", pa.bool_()),
    ]
)


def _cells(raw: bytes, dims: int, rows: int, narrow: bool = False) -> np.ndarray:
    return np.frombuffer(raw, np.int16 if narrow else np.float64).reshape(rows, dims).astype(np.float64)


def _pick(batches):
    """Anchor blocks: the anchors of a task's blocks, by vector length, with where each came from."""
    number = TaskContext.get().partitionId() << 32
    waiting = {}

    def block(dims):
        nonlocal number
        parts = waiting.pop(dims)
        number += 1
        rows = [row for part in parts for row in part[0]]
        return pa.RecordBatch.from_pylist(
            [
                {
                    "anchor_block": number - 1,
                    "dims": dims,
                    "ids": [r[0] for r in rows],
                    "labels": [r[1] for r in rows],
                    "origin": [{"block": r[2], "at": r[3]} for r in rows],
                    "cells": np.concatenate([part[1] for part in parts]).tobytes(),
                }
            ],
            schema=_PICKED,
        )

    for batch in batches:
        for row in batch.to_pylist():
            at = [i for i, yes in enumerate(row["anchors"]) if yes]
            if not at:
                continue
            dims = row["dims"]
            most = max(1, ANCHOR_CELLS // max(1, dims, 16))
            cells = _cells(row["cells"], dims, len(row["ids"]), row["narrow"])
            for some in range(0, len(at), most):
                own = at[some : some + most]
                rows = [(row["ids"][i], row["labels"][i], row["block"], i) for i in own]
                waiting.setdefault(dims, []).append((rows, cells[own]))
                if sum(len(p[0]) for p in waiting[dims]) >= most:
                    yield block(dims)
    for dims in list(waiting):
        yield block(dims)


_PICKED = pa.schema(
    [
        ("anchor_block", pa.int64()),
        ("dims", pa.int32()),
        ("ids", pa.list_(pa.int64())),
        ("labels", pa.list_(pa.int64())),
        ("origin", pa.list_(pa.struct([("block", pa.int64()), ("at", pa.int32())]))),
        ("cells", pa.binary()),
    ]
)


# ---- the best few of a pair of blocks ---------------------------------------


class _Rows:
    """A block of rows in the order of (label, id), rows without an id last."""

    def __init__(self, row, prefix=""):
        ids, labels = row[f"{prefix}ids"], np.array(row[f"{prefix}labels"], np.int64)
        self.ids = np.array([0 if i is None else i for i in ids], np.int64)
        self.nameless = np.array([i is None for i in ids], bool)
        order = np.lexsort((self.ids, self.nameless, labels))
        cells = _cells(row["cells"], row["dims"], len(ids), row["narrow"])
        self.at, self.cells, self.labels = order, cells[order], labels[order]
        self.ids, self.nameless = self.ids[order], self.nameless[order]
        self.place = np.empty(len(ids), np.int64)
        self.place[np.lexsort((self.ids, self.nameless))] = np.arange(len(ids))


def _first(few: int, groups, *order):
    """Places of the first `few` of each group, by descending first and ascending second key."""
    by = np.lexsort((order[1], -order[0], groups))
    ranked = groups[by]
    return by[np.arange(len(by)) - np.searchsorted(ranked, ranked) < few]


def _pairs(batches):
    """(anchor row, its cells, block of rows); a block of rows is decoded once for the anchors that follow it."""
    last, rows = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != last:
                last, rows = row["block"], _Rows(row)
            yield row, _cells(row["a_cells"], row["a_dims"], len(row["a_ids"])), rows


def _emit(schema, **columns):
    arrays = [pa.array(columns[f.name], f.type, mask=columns.get(f"{f.name}_null")) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


_POSITIVE = pa.schema(
    [("anchor_block", pa.int64()), ("anchor", pa.int32()), ("id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("score", pa.int64())]
)


def _positives(few):
    def find(batches):
        for row, cells, rows in _pairs(batches):
            labels = np.array(row["a_labels"], np.int64)
            for label in np.unique(labels):
                low, high = (np.searchsorted(rows.labels, label, side) for side in ("left", "right"))
                if low == high:
                    continue
                own = np.flatnonzero(labels == label)
                step = max(1, HELD // int(high - low))
                for some in range(0, len(own), step):
                    part = own[some : some + step]
                    scores = products(cells[part], rows.cells[low:high])
                    # The anchor itself is no positive of its own.
                    for i, a in enumerate(part):
                        origin = row["origin"][a]
                        if origin["block"] == row["block"]:
                            scores[i, rows.at[low:high] == origin["at"]] = -LARGEST - 1
                    # Whatever ties with the last of the best few stays until ids decide.
                    k = min(few, high - low)
                    least = np.partition(scores, high - low - k, axis=1)[:, high - low - k]
                    g, c = np.nonzero((scores >= least[:, None]) & (scores > -LARGEST - 1))
                    best = _first(few, g, scores[g, c], c)
                    g, c = g[best], c[best]
                    yield _emit(
                        _POSITIVE,
                        anchor_block=np.full(len(g), row["anchor_block"], np.int64),
                        anchor=part[g].astype(np.int32),
                        id=rows.ids[low + c],
                        id_null=rows.nameless[low + c],
                        block=np.full(len(g), row["block"], np.int64),
                        at=rows.at[low + c].astype(np.int32),
                        score=scores[g, c],
                    )

    return find


_NEGATIVE = pa.schema(
    [
        ("anchor_block", pa.int64()),
        ("anchor", pa.int32()),
        ("nth", pa.int32()),
        ("anchor_id", pa.int64()),
        ("positive_id", pa.int64()),
        ("positive_score", pa.int64()),
        ("negative_id", pa.int64()),
        ("negative_score", pa.int64()),
    ]
)


def _negatives(few, least_percent, most_percent):
    def bounds(score):
        """The least and the greatest whole score between the percentages; Python integers don't overflow."""
        return -(-least_percent * score // 100), most_percent * score // 100

    def find(batches):
        for row, cells, rows in _pairs(batches):
            labels = np.array(row["a_labels"], np.int64)
            wanted = [(p["anchor"], p["nth"], p["id"], p["score"], *bounds(p["score"])) for p in row["positives"]]
            wanted = [w for w in wanted if w[4] <= w[5]]
            if not wanted:
                continue
            anchors = np.array([w[0] for w in wanted], np.int64)
            low, high = (np.clip(np.array([w[k] for w in wanted], object), -LARGEST, LARGEST).astype(np.int64) for k in (4, 5))
            step = max(1, HELD // max(1, len(rows.ids)))
            needed = np.unique(anchors)
            for some in range(0, len(needed), step):
                part = needed[some : some + step]
                scores = products(cells[part], rows.cells)
                here = np.flatnonzero((anchors >= part[0]) & (anchors <= part[-1]))
                slot = np.searchsorted(part, anchors[here])
                lows = np.full(len(part), LARGEST)
                highs = np.full(len(part), -LARGEST)
                np.minimum.at(lows, slot, low[here])
                np.maximum.at(highs, slot, high[here])
                inside = (scores >= lows[:, None]) & (scores <= highs[:, None]) & (labels[part][:, None] != rows.labels)
                g, c = np.nonzero(inside)
                by = np.lexsort((rows.place[c], -scores[g, c], g))
                g, c = g[by], c[by]
                s = scores[g, c]
                # The hits of an anchor stand together, best first: each positive takes its first few of them.
                starts, ends = np.searchsorted(g, slot), np.searchsorted(g, slot, "right")
                at, nth = [], []
                for w, start, end in zip(here, starts, ends):
                    fits = start + np.flatnonzero((s[start:end] <= high[w]) & (s[start:end] >= low[w]))[:few]
                    at.append(fits)
                    nth.append(np.full(len(fits), w))
                at, nth = np.concatenate(at), np.concatenate(nth)
                if not len(at):
                    continue
                chosen = [wanted[w] for w in nth]
                yield _emit(
                    _NEGATIVE,
                    anchor_block=np.full(len(at), row["anchor_block"], np.int64),
                    anchor=anchors[nth].astype(np.int32),
                    nth=np.array([w[1] for w in chosen], np.int32),
                    anchor_id=np.array([row["a_ids"][w[0]] for w in chosen], np.int64),
                    positive_id=[w[2] for w in chosen],
                    positive_score=np.array([w[3] for w in chosen], np.int64),
                    negative_id=rows.ids[c[at]],
                    negative_id_null=rows.nameless[c[at]],
                    negative_score=s[at],
                )

    return find


# ---- the operator -----------------------------------------------------------


def usable(label: Column, vector: Column) -> Column:
    """Rows with a label and a vector of finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return label.isNotNull() & F.coalesce(finite, F.lit(False))


def mine(
    rows: DataFrame,
    label: Column,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    vector: str = "embedding",
) -> DataFrame:
    """Hard negatives of the anchors among rows of `vec_id` and a vector.

    An anchor's positives are its best `positives` other rows of the same label; for each of
    them the best `negatives` rows of other labels that score between `least` and `most`
    percent of it, ranked from 1. `label` and `anchor` are columns over rows.
    """
    spark = rows.sparkSession
    taken = rows.select(
        F.col("vec_id").cast("bigint").alias("id"),
        label.cast("bigint").alias("label"),
        (F.coalesce(anchor, F.lit(False)) & F.col("vec_id").isNotNull()).alias("anchor"),
        F.col(vector).cast("array<double>").alias("vec"),
        usable(label, F.col(vector)).alias("usable"),
    )
    blocks = stored(taken.where("usable").drop("usable").mapInArrow(_pack, BLOCK))
    number = blocks.count()
    # Few anchors in a block of rows: a task picks from many, so that blocks of anchors are full.
    picked = stored(blocks.coalesce(max(1, number // BLOCKS_PICKED)).mapInArrow(_pick, ANCHORS))
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(number, max(2 * cores, math.ceil(number / BLOCKS_PER_PART))))
    dealt = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts))).drop("anchors")

    zero, last = (F.lit(n).cast("bigint") for n in (0, parts - 1))

    def everywhere(anchors):
        """Every pair of an anchor block and a block of rows."""
        own = [F.col(c).alias(f"a_{c}") if c in ("dims", "ids", "labels", "cells") else F.col(c) for c in anchors.columns]
        copies = anchors.select(*own, F.explode(F.sequence(zero, last)).alias("part"))
        return dealt.join(copies, "part").drop("part")

    def best(found, few, keys, score, name):
        order = W.partitionBy(*keys).orderBy(F.desc(score), F.asc_nulls_last(name))
        return found.withColumn("nth_best", F.row_number().over(order)).where(F.col("nth_best") <= few)

    found = everywhere(picked).mapInArrow(_positives(positives), "anchor_block bigint, anchor int, id bigint, block bigint, at int, score bigint")
    first = best(found, positives, ["anchor_block", "anchor"], "score", "id")
    # As many as an anchor block has rows, times `positives`.
    per_block = first.groupBy("anchor_block").agg(
        F.collect_list(F.struct("anchor", F.col("nth_best").alias("nth"), "id", "score")).alias("positives")
    )
    asking = stored(picked.drop("origin").join(per_block, "anchor_block"))
    found = everywhere(asking).mapInArrow(
        _negatives(negatives, least, most),
        "anchor_block bigint, anchor int, nth int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint",
    )
    chosen = best(found, negatives, ["anchor_block", "anchor", "nth"], "negative_score", "negative_id")
    return chosen.select(
        "anchor_id", "positive_id", F.col("nth_best").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"
    )
