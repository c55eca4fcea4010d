"""Stages against plain Python on the rows each is given."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DATA, odd_docs, read
from tests.llm.test_decontaminate import brute
from tests.llm.test_neardup import brute_classes
from tests.llm.test_packing import check
from tidemark.llm import quality, stages
from tidemark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def ids(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_in_order(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing",
    ]
    docs = table(spark, DATA, "documents")
    labels, benchmark = read("labels", DATA), read("benchmark", DATA)
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = stored(stages.quality_filter(spark, docs, DATA))
    model = quality.train(docs, table(spark, DATA, "labels"))
    scores = dict(zip(rows, model.scores(rows.values())))
    assert kept.columns == COLUMNS and ids(kept) == sorted(i for i, s in scores.items() if s >= 0.3)
    bad = set(labels[labels["quality"] == 0]["doc_id"])
    assert len(bad & set(ids(kept))) < 0.1 * len(bad)

    rows = {i: rows[i] for i in ids(kept)}
    kept = stored(stages.exact_dedup(spark, kept, DATA))
    rows = {i: t for t, i in {t: i for i, t in sorted(rows.items())}.items()}
    assert kept.columns == COLUMNS and ids(kept) == sorted(rows)

    kept = stored(stages.near_dedup(spark, kept, DATA))
    rows = {i: rows[i] for i in set(brute_classes(list(rows.items())).values())}
    assert kept.columns == COLUMNS and ids(kept) == sorted(rows)

    kept = stored(stages.decontaminate(spark, kept, DATA))
    hits = dict(zip(rows, brute(rows.values(), benchmark.values.tolist())))
    rows = {i: t for i, t in rows.items() if not hits[i][3]}
    assert kept.columns == COLUMNS and ids(kept) == sorted(rows)

    check(stages.pack(spark, kept, DATA).collect(), rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_odd_rows_and_columns(spark, stage):
    docs = odd_docs(spark, "a b c d e f", None, "", "z " * 1000, ids=[1, 2, None, 3])
    out = stage(spark, docs, DATA)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert out.count() <= 4
    assert stage(spark, docs.limit(0), DATA).count() == 0


def rows_of(frame):
    return sorted(((r.doc_id, r.text) for r in frame.collect()), key=repr)


BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
NEAR = "zero " + BASE
FAR = "entirely other words stand in this one and nothing of it is anywhere else"


def test_exact_dedup_decides_by_row(spark):
    texts = ["same", "same", "same", "lone", "lone", "twice", "twice", "", None, "a", "b", "b"]
    ids = [None, None, 3, None, None, 5, 5, 7, None, 9, 9, 10]
    got = rows_of(stages.exact_dedup(spark, odd_docs(spark, *texts, ids=ids), DATA))
    assert got == sorted([(3, "same"), (None, "lone"), (5, "twice"), (7, ""), (9, "a"), (10, "b")], key=repr)


def test_near_dedup_decides_by_row(spark):
    texts = [BASE, BASE, NEAR, FAR, FAR, FAR, BASE.upper(), "", "", None]
    # Two classes: one led by id 2 (twice), one of rows without ids.
    ids = [2, 2, None, None, None, None, 8, 4, 4, None]
    got = rows_of(stages.near_dedup(spark, odd_docs(spark, *texts, ids=ids), DATA))
    assert got == sorted([(2, BASE), (None, FAR), (4, ""), (4, ""), (None, None)], key=repr)


def test_near_dedup_of_an_id_with_two_texts(spark):
    docs = odd_docs(spark, BASE, NEAR, FAR, BASE, ids=[1, 1, 1, 6])
    got = rows_of(stages.near_dedup(spark, docs, DATA))
    assert len(got) == 2 and (1, FAR) in got and got[0] in [(1, t) for t in (BASE, NEAR, FAR)]


def test_stages_with_clashing_columns(spark):
    docs = odd_docs(spark, BASE, BASE, FAR, None)
    for name in ("score_of_text", "sha_of_text", "benchmark_found", "id", "sha", "n", "part", "node"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        assert all(r.sha_of_text == "own sha_of_text" and r.score_of_text == "own score_of_text" for r in out.collect())
