import random

from tests.llm.conftest import odd_docs
from tidemark.llm import exact_dedup as dedup


def test_filter_has_no_false_negatives_and_deletes():
    rng = random.Random(1)
    keys = [rng.randbytes(32) for _ in range(5000)]
    index = dedup.CuckooIndex(buckets=2)
    for k, digest in enumerate(keys):
        index.add(digest, k)
    assert index.resizes > 0
    assert all(index.find(d) == [k, 1] for k, d in enumerate(keys))
    for digest in keys[::2]:
        assert index.remove(digest)
    assert not index.remove(keys[0])
    assert all(index.find(d) is None for d in keys[::2])
    assert all(index.find(d) for d in keys[1::2])
    assert index.filter.size == 2500
    absent = [rng.randbytes(32) for _ in range(5000)]
    assert all(index.find(d) is None for d in absent)


def test_edges(spark):
    docs = odd_docs(spark, "a", "a", None, "", "A", "a ", "a", "é" * 300_000, ids=[1, 7, 3, 5, 9, 11, None, 13])
    rows = dedup.deduplicate(docs).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert len(rows) == 8
    assert got[1] == (7, 3, False) and got[7] == (7, 3, True) and got[None] == (7, 3, False)
    assert got[3] == (5, 2, False) and got[5] == (5, 2, True)
    assert got[9] == (9, 1, True) and got[11] == (11, 1, True) and got[13][2]
    assert dedup.deduplicate(docs.limit(0)).count() == 0
    nameless = dedup.deduplicate(odd_docs(spark, "q", "q", ids=[None, None])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in nameless] == [(None, 2, True)] * 2
    twice = dedup.deduplicate(odd_docs(spark, "q", "q", ids=[4, 4])).collect()
    assert [(r.keep_id, r.group_size, r.kept) for r in twice] == [(4, 2, True)] * 2


def test_hot_group_reaches_the_index_in_few_rows(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'copy', CAST(id AS STRING)) AS text")
    rows = {r.sha: r for r in dedup.index_of(dedup.digests(docs)).collect()}
    hot = rows[dedup.digest_of("copy").hex()]
    assert (hot.keep_id, hot.group_size) == (19_998, 6_667)
    assert len(rows) == 13_334


def test_update_index(spark):
    index = dedup.index_of(dedup.digests(odd_docs(spark, "a", "b", "b", "c")))
    sha = lambda t: dedup.digest_of(t).hex()
    changes = spark.createDataFrame(
        [(sha("b"), None, "remove"), (sha("zz"), None, "remove"), (sha("a"), 40, "add"), (sha("a"), 30, "add"), (sha("n"), 50, "add"), (sha("c"), 9, "remove"), (sha("c"), 60, "add")],
        "sha string, doc_id long, change string",
    )
    got = {r.sha: (r.keep_id, r.group_size) for r in dedup.update_index(index, changes).collect()}
    assert got == {sha("a"): (40, 3), sha("n"): (50, 1), sha("c"): (60, 1)}
