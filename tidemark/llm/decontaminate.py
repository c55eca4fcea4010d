"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are folded to words (A-Z lower-cased; letters, digits and all non-ASCII
characters form words) joined by single spaces. Every window of 13 consecutive
words of a benchmark item (or the whole item, if shorter) is a pattern with a
space at both ends. One pass of the automaton over a document finds all windows;
word numbers follow from the spaces, and `spans` maps hits to the original text.

Cases: null or empty texts, and texts without words, have no words and no hits;
items without words have no windows; a window that several items share counts
for each; items that share an id count once; a document is contaminated if it
has a hit and at least one word in twenty is hit. Texts are scanned whole.
Repeated rows are judged one by one, empty tables are fine, and only the named
columns are read.
"""

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folded

WINDOW = 13
#: Benchmark text that one automaton may hold. Beyond it the items are scanned in
#: blocks of this size, one broadcast and one automaton after the other.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HIT = "n_words long, n_hit long, items array<string>, runs array<struct<first: int, last: int>>"
_machines: dict = {}


def windows(text: str | None, width: int = WINDOW) -> Iterator[tuple[int, str]]:
    """(number of words, pattern) of each window of an item."""
    words = folded(text).decode("latin-1").split()
    width = min(width, len(words))
    if width:
        for at in range(len(words) - width + 1):
            yield width, " " + " ".join(words[at : at + width]) + " "


def automaton(items: list[tuple[str, str]], width: int = WINDOW):
    """An automaton over (item id, text) pairs, or None if they have no words."""
    owners: dict[str, tuple[int, set]] = {}
    for item, text in items:
        for n, pattern in windows(text, width):
            owners.setdefault(pattern, (n, set()))[1].add(item)
    if not owners:
        return None
    machine = ahocorasick.Automaton()
    for pattern, (n, ids) in owners.items():
        machine.add_word(pattern, (n, tuple(ids)))
    machine.make_automaton()
    return machine


def scan(machine, text: str | None) -> tuple[int, list[tuple[int, int]], set]:
    """(words, disjoint runs [first, last) of hit words, ids of found items)."""
    words = folded(text).split()
    if machine is None or not words:
        return len(words), [], set()
    # Latin-1 keeps one character a byte, so patterns and text are compared bytewise.
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end, n, ids) for end, (n, ids) in machine.iter(line)]
    if not found:
        return len(words), [], set()
    number = np.cumsum(np.frombuffer(line.encode("latin-1"), dtype=np.uint8) == 32)
    runs: list[tuple[int, int]] = []
    ids: set = set()
    for first, last in sorted((int(number[end]) - 1 - n, int(number[end]) - 1) for end, n, _ in found):
        if runs and first <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(last, runs[-1][1]))
        else:
            runs.append((first, last))
    for _, _, more in found:
        ids.update(more)
    return len(words), runs, ids


def spans(text: str, runs) -> list[tuple[int, int]]:
    """Code point offsets [start, end) in the original text of runs of words."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[first][0], places[last - 1][1]) for first, last in runs]


def _machine_of(block) -> object:
    """The block's automaton, built once per Python worker; only the latest is kept."""
    key = block.value[0]
    if key not in _machines:
        _machines.clear()
        _machines[key] = automaton(block.value[1])
    return _machines[key]


def _scanner(block):
    @F.pandas_udf(_HIT)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = _machine_of(block)
        for part in texts:
            rows = [scan(machine, t) for t in part]
            yield pd.DataFrame(
                {
                    "n_words": [n for n, _, _ in rows],
                    "n_hit": [sum(b - a for a, b in runs) for _, runs, _ in rows],
                    "items": [sorted(ids) for _, _, ids in rows],
                    "runs": [[{"first": a, "last": b} for a, b in runs] for _, runs, _ in rows],
                }
            )

    return hits


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int):
    """Lists of (id, text) of bounded size each. An item is never split; the driver
    holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")), text).where(F.col(text).isNotNull()).toLocalIterator():
        if block and size + len(row[1]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((str(row[0]), row[1]))
        size += len(row[1])
    yield block


def _merge(runs_of_blocks) -> list[dict]:
    merged: list[list[int]] = []
    for run in sorted((r["first"], r["last"]) for r in runs_of_blocks):
        if merged and run[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], run[1])
        else:
            merged.append(list(run))
    return [{"first": a, "last": b} for a, b in merged]


def _union_of_runs(runs: pd.Series) -> pd.DataFrame:
    merged = [_merge(r) for r in runs]
    return pd.DataFrame({"n_hit": [sum(x["last"] - x["first"] for x in m) for m in merged], "runs": merged})


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    into: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """docs with a struct column `into`: n_words, n_hit, items, runs, contaminated.

    One map over the documents and no shuffle. With more benchmark text than a
    block holds, each block adds a column of its own and the columns are merged,
    still within the row: no join, whatever the number of blocks.
    """
    context = docs.sparkSession.sparkContext
    parts = []
    for block in _blocks(benchmark, item, item_text, block_bytes):
        key = hashlib.sha256(repr(block).encode()).hexdigest()
        parts.append(_scanner(context.broadcast((key, block)))(F.col(text)))
    if len(parts) == 1:
        out = docs.withColumn(into, parts[0])
    else:
        names = [f"{into}__{k}" for k in range(len(parts))]
        out = docs
        for name, part in zip(names, parts):
            out = out.withColumn(name, part)
        union = F.pandas_udf(_union_of_runs, "n_hit long, runs array<struct<first: int, last: int>>")
        out = out.withColumn(f"{into}__u", union(F.concat(*[F.col(f"{n}.runs") for n in names])))
        out = out.withColumn(
            into,
            F.struct(
                F.col(f"{names[0]}.n_words").alias("n_words"),
                F.col(f"{into}__u.n_hit").alias("n_hit"),
                F.array_sort(F.array_distinct(F.concat(*[F.col(f"{n}.items") for n in names]))).alias("items"),
                F.col(f"{into}__u.runs").alias("runs"),
            ),
        ).drop(f"{into}__u", *names)
    hit, words = F.col(f"{into}.n_hit"), F.col(f"{into}.n_words")
    return out.withColumn(into, F.col(into).withField("contaminated", (hit > 0) & (hit * 20 >= words)))
