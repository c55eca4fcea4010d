"""The filter audit against a plain count over every order."""

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_docs
from tidemark.llm import filter_audit

CONDITIONS = [lambda t: len(t) < 4, lambda t: "x" in t]


def filters():
    return {"S": F.char_length("text") < 4, "X": F.col("text").rlike("x")}


def brute(rows, labels, repeated="E"):
    """rows: (id, text, part) as given; a Counter of result rows."""
    rows = [(i, t or "", p or "") for i, t, p in rows]
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    names = "SX" + repeated
    fails = []
    for i, t, p in rows:
        before = i is not None and any(j is not None and j < i and u == t for j, u, _ in rows)
        fails.append([c(t) for c in CONDITIONS] + [before])
    found = {}
    for part in {p for _, _, p in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if r[2] == part]
        shapley = Counter()
        for order in permutations(range(len(names))):
            left = mine
            for step, k in enumerate(order, 1):
                gone = [m for m in left if m[1][k]]
                left = [m for m in left if not m[1][k]]
                all_failing = [m for m in mine if m[1][k]]
                found[part, "".join(names[o] for o in order), step] = [
                    len(left),
                    len(gone),
                    len(all_failing) - len(gone),
                    sum(sum(m[1]) == 1 for m in all_failing),
                    sum(m[0] in good for m in gone),
                    sum(m[0] in toxic for m in gone),
                ]
                shapley[k] += len(gone)
        for p, order, step in list(found):
            if p == part:
                found[p, order, step].append(shapley[names.index(order[step - 1])])
    return {(*k, *v) for k, v in found.items()}


def audited(spark, docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return {tuple(r) for r in filter_audit.audit(docs, known, filters(), "E").collect()}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


ODD = [
    (1, "same", "a"), (2, "same", "b"), (2, "same", "a"), (3, "same", None), (3, "same", ""),
    (4, None, "a"), (5, "", "a"), (6, "x", "b"), (6, "xx", "b"), (7, "x", "a"),
    (None, "same", "a"), (None, "same", "a"), (None, "rare x", "b"), (8, "rare x", "b"), (9, "long " * 40000, "a"),
    (10, "long " * 40000, "b"), (11, "x" * 9, "a"), (11, "x" * 9, "a"),
]
LABELS = [(2, 1, 0), (2, 0, 1), (3, 1, 1), (6, None, 1), (None, 1, 1), (99, 1, 1), (7, 1, None)]


def test_odd_rows(spark):
    assert audited(spark, docs_of(spark, ODD), LABELS) == brute(ODD, LABELS)


def test_rare_and_hot_hashes(spark):
    """A third is one text, which is hot; pairs of copies are too rare to be."""
    rows = [(i, "hot text", f"s{i % 3}") for i in range(0, 2400, 3)]
    rows += [(i, f"pair {i // 6} x" if i % 2 else f"own {i}", f"s{i % 3}") for i in range(1, 2400, 3)]
    rows += [(i, f"pair {i // 6} x", "s0") for i in range(2, 2400, 3)]
    labels = [(i, i % 2, i % 5 == 0) for i in range(0, 2400, 7)]
    labels = [(i, q, int(x)) for i, q, x in labels]
    assert audited(spark, docs_of(spark, rows).repartition(7), labels) == brute(rows, labels)


def test_empty_table_and_clashing_columns(spark):
    assert filter_audit.audit(docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters(), "E").count() == 0
    docs = odd_docs(spark, "abcd", "abcd", None).withColumns({"hash": F.lit(1), "bits": F.lit(7), "n": F.lit(0), "id": F.lit(3), "part": F.lit("p")})
    assert audited(spark, docs, []) == brute([(0, "abcd", "s"), (1, "abcd", "s"), (2, None, "s")], [])


def test_words_are_runs_without_ascii_space(spark):
    made = spark.createDataFrame([(" a\x0bb\tc\x1fd e  ",), ("",)], "text string")
    assert [r[0] for r in made.select(filter_audit.words(F.col("text"))).collect()] == [["a", "b", "c\x1fd e"], []]


def test_too_many_filters(spark):
    with pytest.raises(ValueError):
        filter_audit.interactions(spark.createDataFrame([], "part string, bits int, n long, good long, toxic long"), "ABCDEFGH")
