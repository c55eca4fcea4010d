import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, odd_docs, read
from tests.llm.test_decontaminate import words
from tidemark.llm import neardup


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_classes(docs):
    """doc_id -> smallest id of its component under exact Jaccard similarity of 0.8."""
    sets = {i: shingles(t) for i, t in docs}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in sets.items():
        shared = {}
        for x in s:
            for j in holders[x]:
                shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if j != i and n / (len(s) + len(sets[j]) - n) >= 0.8:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_equals_brute_force(spark):
    docs = read("documents", DATA)
    got = neardup.classes(spark.createDataFrame(docs[["doc_id", "text"]])).collect()
    want = brute_classes(docs[["doc_id", "text"]].values.tolist())
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = {c: list(want.values()).count(c) for c in set(want.values())}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_of_near_copies_and_a_chain(spark):
    """A third of the rows are edits of one text; others drift away from it step by step."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = []
    for k in range(100):
        edit = list(base)
        edit[rng.randrange(120)] = f"edit{k}"
        texts.append(" ".join(edit))
    drift = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    for k in range(30):
        texts.append(" ".join(drift))
        drift[4 * k % 120] = f"step{k}"
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(60)) for _ in range(170)]
    got = neardup.classes(odd_docs(spark, *texts)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(list(enumerate(texts)))


def test_edges(spark):
    texts = ["one two", "One, TWO!", None, "", "...", "one two three", "a b c d e f g", "a b c d e f g", "z " * 50_000, "z " * 60_000]
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in neardup.classes(odd_docs(spark, *texts)).collect()}
    assert got[0] == (0, 2, True) and got[1] == (0, 2, False)
    for k in (2, 3, 4, 5):
        assert got[k] == (k, 1, True)
    assert got[6] == (6, 2, True) and got[7] == (6, 2, False)
    assert got[8] == (8, 2, True) and got[9] == (8, 2, False)
    assert neardup.classes(odd_docs(spark, "a").limit(0)).count() == 0
    nameless = neardup.classes(odd_docs(spark, "a b c d e f", "a b c d e f", "", ids=[None, 5, None])).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.kept) for r in nameless) == [(0, 0, True), (0, 5, False), (5, 5, True)]


def test_registers_estimate_probability_jaccard():
    """Share of equal registers against the exact value over many random weighted sets."""
    rng = np.random.default_rng(2)
    exact, estimate = [], []
    for trial in range(60):
        ids = rng.choice(2**40, 80, replace=False).astype(np.uint64)
        a, b = rng.integers(0, 6, 80), rng.integers(0, 6, 80)
        b = np.where(rng.random(80) < 0.6, a, b)
        sigs = []
        for counts in (a, b):
            some = counts > 0
            sigs.append(neardup.registers(ids[some], counts[some], 1, 512)[0])
        wa, wb = (np.where(c > 0, 1 + np.log(np.maximum(c, 1)), 0) for c in (a, b))
        both = (wa > 0) & (wb > 0)
        # J_P: sum over shared elements of 1 / sum over all of max of the two relative weights.
        exact.append(sum(1 / np.maximum(wa / wa[k], wb / wb[k]).sum() for k in np.flatnonzero(both)))
        estimate.append((sigs[0] == sigs[1]).mean())
    assert abs(np.mean(np.array(exact) - np.array(estimate))) < 0.01
    assert np.abs(np.array(exact) - np.array(estimate)).max() < 0.1


def test_pairs_are_linear_in_a_bucket(spark):
    members = spark.range(1000).selectExpr("1L AS bucket", "hash(id) * 1L AS order", "id AS part", "id AS node", "id % 7 AS weight", f"unhex(repeat('07', {neardup.REGISTERS})) AS sketch")
    assert neardup.star_pairs(members).count() == 999
    pairs, centres = neardup.central_pairs(members)
    assert pairs.count() == 999 and centres.count() == 1
    again, others = neardup.central_pairs(members, centres)
    assert again.count() == 999 and others.first().part != centres.first().part
    near = neardup.neighbour_pairs(members.repartition(3), 1)
    assert near.count() <= 999 * neardup.NEIGHBOURS
    one = members.withColumn("part", F.lit(5))
    assert neardup.central_pairs(one)[0].count() == neardup.neighbour_pairs(one, 1).count() == 0


def test_neighbours_across_batches():
    """Pairs within reach of each other, each once, however the rows are cut into frames."""
    import pandas as pd

    rows = pd.DataFrame({"bucket": [1] * 9 + [2] * 4, "part": range(13), "node": range(13)})
    rows["sketch"] = [b"s" * neardup.REGISTERS] * 13
    want = {(i, j) for i in range(13) for j in range(i + 1, min(13, i + 1 + neardup.NEIGHBOURS)) if (i < 9) == (j < 9)}
    for size in (1, 2, 3, 5, 13):
        frames = [rows[k : k + size] for k in range(0, 13, size)]
        got = [tuple(p) for f in neardup._side_by_side(iter(frames)) for p in f.to_numpy().tolist()]
        assert len(got) == len(set(got)) and set(got) == want
    # Too few registers agree with one of them.
    rows.at[3, "sketch"] = b"s" * (neardup.AGREE - 1) + b"t" * (neardup.REGISTERS - neardup.AGREE + 1)
    got = {tuple(p) for f in neardup._side_by_side(iter([rows])) for p in f.to_numpy().tolist()}
    assert got == {p for p in want if 3 not in p}


def test_components_of_a_long_chain(spark):
    """Numbers in random order along the chain, and a loop, and a separate pair."""
    order = list(range(400))
    random.Random(1).shuffle(order)
    edges = list(zip(order, order[1:])) + [(order[0], order[-1]), (1000, 1001)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(400)} | {1000: 1000, 1001: 1000}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_inside_a_large_group_of_texts_that_are_no_links(spark):
    """Edits of one template have a similarity of about 0.65; each has one partner at 0.8 exactly."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    pairs = []
    for k in range(1500):
        one = list(base)
        for at in rng.sample(range(10, 390, 10), 9):
            one[at] = f"a{rng.randrange(10**6)}"
        two = list(one)
        for at in [3, *rng.sample(range(15, 390, 10), 8)]:
            two[at] = f"b{rng.randrange(10**6)}"
        pairs.append((" ".join(one), " ".join(two)))
    assert all(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) == 0.8 for a, b in pairs[:20])
    docs = odd_docs(spark, *(t for p in pairs for t in p)).repartition(8)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {k: k - k % 2 for k in range(3000)}


def test_repeated_lines_do_not_hide_a_link(spark):
    """Set similarity just above 0.8; in one text half of the shared shingles recur fifty times."""
    texts = []
    for k in range(150):
        one = [f"{k}x{j}" for j in range(64)]
        two = list(one)
        two[-1] = two[0] = f"{k}y"
        texts += [" ".join(one), " ".join(two + one[2:34] * 50)]
    got = neardup.classes(odd_docs(spark, *texts)).collect()
    want = brute_classes(list(enumerate(texts)))
    assert len(set(want.values())) == 150
    assert {r.doc_id: r.class_id for r in got} == want
