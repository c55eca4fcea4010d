"""The curriculum against plain water filling, a plain running sum, and the integral itself."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_docs
from tidemark.llm import curriculum


def brute_targets(sizes, most=3):
    """sizes in order of source; shares by weight, closes what is above its limit, shares again."""
    weights = [i % 3 + 1 for i in range(len(sizes))]
    closed = set()
    while True:
        left = Fraction(sum(sizes)) - sum(most * sizes[i] for i in closed)
        weight = sum(w for i, w in enumerate(weights) if i not in closed)
        target = [Fraction(most * s) if i in closed else left * weights[i] / weight for i, s in enumerate(sizes)]
        above = {i for i in range(len(sizes)) if i not in closed and target[i] >= most * sizes[i]}
        if not above:
            return target
        closed |= above


def brute(rows):
    """rows: (id, source, size); Counter of (id, size, source size, taken), and the targets."""
    by = defaultdict(list)
    for i, source, size in rows:
        by[source].append((hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), size, i))
    names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    sizes = [sum(x[1] for x in by[s]) for s in names]
    found = Counter()
    for name, total, target in zip(names, sizes, brute_targets(sizes)):
        demand, at = math.floor(target + Fraction(1, 2)), 0
        for _, size, i in sorted(by[name], key=lambda x: x[:2]):
            taken = sum(min(size, max(0, demand - at - turn * total)) for turn in range(3))
            found[i, size, total, taken] += 1
            at += size
    return found, dict(zip(names, brute_targets(sizes)))


def docs_of(spark, rows):
    made = [(i, s, " ".join("w" * n)) for i, s, n in rows]
    return spark.createDataFrame(made, "doc_id long, source string, text string")


def mixed(docs):
    slope = F.when(F.col("rank") % 2 == 1, F.lit(0.5)).otherwise(F.lit(-0.5))
    return curriculum.mix(docs, (F.col("rank") - 1) % 3 + 1, curriculum.ramp(F.col("weight"), slope))


def check(spark, rows):
    got = mixed(docs_of(spark, rows).repartition(5)).collect()
    want, targets = brute(rows)
    assert Counter((r.doc_id, r["size"], r.source_size, r.taken) for r in got) == want
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(float(targets[r.source]), rel=1e-14)
        assert r.taken <= 3 * r["size"] and len(r.positions) <= 3
        assert list(r.positions) == sorted(r.positions) and all(0 <= p < 1 for p in r.positions)
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= Fraction(1, 2)
    return got


def test_random_tables(spark):
    rng = random.Random(5)
    for sources in (1, 4, 9):
        names = [f"s{k}" for k in range(sources)] + [None]
        rows = [(rng.choice([None, k, k % 50]), names[min(int(rng.expovariate(1.2)), sources)], int(rng.paretovariate(1.1)) - 1) for k in range(400)]
        check(spark, rows)


def test_a_third_without_id_and_one_hot_source(spark):
    rows = [(None if k % 3 == 0 else k, "hot" if k % 3 else ["a", "b", None, ""][k % 4], k % 7) for k in range(600)]
    check(spark, rows)


def test_one_long_document_is_taken_in_part(spark):
    got = check(spark, [(1, "a", 5000), (2, "b", 10), (3, "c", 10)])
    assert {r.doc_id: r.taken for r in got} == {1: 4960, 2: 30, 3: 30}


def test_no_words_and_no_rows(spark):
    got = mixed(odd_docs(spark, None, "", " \t\x0b")).collect()
    assert [(r["size"], r.target, r.taken, r.positions) for r in got] == [(0, 0.0, 0, [])] * 3
    assert mixed(odd_docs(spark)).count() == 0


def test_positions_invert_the_demand(spark):
    """At a document's position the schedule has asked for the words that come before it."""
    rows = [(k, f"s{k % 2}", 10) for k in range(500)]
    got = mixed(docs_of(spark, rows)).collect()
    for name, slope in (("s0", 0.5), ("s1", -0.5)):
        mine = sorted(p for r in got if r.source == name for p in r.positions)
        target = next(r.target for r in got if r.source == name)
        asked = [(1 - slope) * p + slope * p * p for p in mine]
        assert np.allclose(np.array(asked) * target, np.arange(len(mine)) * 10, atol=1e-6)


def test_schedules_of_several_knots(spark):
    """A source that only comes in the second half, and one that fades out to nothing."""
    late = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (0.5, 0.0), (0.5, 2.0), (1.0, 2.0))])
    fading = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 2.0), (1.0, 0.0))])
    docs = docs_of(spark, [(k, "ab"[k % 2], 10) for k in range(400)])
    made = curriculum.mix(docs, F.lit(1), F.when(F.col("rank") == 1, late).otherwise(fading))
    run = curriculum.curriculum(made).collect()
    positions = [r.position for r in run]
    assert positions == sorted(positions) and len(run) == 400
    first = [r.position for r in run if r.source == "a"]
    assert min(first[1:]) > 0.5 and np.allclose(np.diff(first[1:]), 0.5 / 200)
    second = np.array([r.position for r in run if r.source == "b"])
    assert np.allclose(2 * second - second**2, np.arange(200) / 200)


def test_reruns_and_layout_agree_and_nothing_is_python(spark):
    rows = [(k, f"s{k % 5}", k % 13) for k in range(300)]
    docs = docs_of(spark, rows)
    first, second = (sorted(map(repr, mixed(d).collect())) for d in (docs, docs.repartition(9, "text")))
    assert first == second
    plan = mixed(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_clashing_columns(spark):
    docs = odd_docs(spark, "a b", "c").withColumns({"from": F.lit(1), "bucket": F.lit("x"), "rank": F.lit(9), "size": F.lit(5)})
    assert sorted((r.doc_id, r["size"], r.taken) for r in mixed(docs).collect()) == [(0, 2, 2), (1, 1, 1)]
