import re

import pytest

from tests.llm.conftest import DATA, odd_docs, read
from tidemark.llm import decontaminate as decon

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(texts, items):
    """Hit words and items of each text by comparing every window at every place."""
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in texts:
        w, hit, ids = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((len(w), len(hit), sorted(ids), 0 < len(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [decon.BLOCK_BYTES, 1500])
def test_equals_brute_force(spark, block):
    docs, items = read("documents", DATA), read("benchmark", DATA)
    want = dict(zip(docs["doc_id"], brute(docs["text"], items.values.tolist())))
    found = decon.find(spark.createDataFrame(docs[["doc_id", "text"]]), spark.createDataFrame(items), block_bytes=block)
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.select("doc_id", "found.*").collect()}
    assert got == want
    assert any(w[3] for w in want.values())


def test_edges(spark):
    long = "w%d " * 13 % tuple(range(13))
    items = spark.createDataFrame(
        [(1, "Alpha, BETA!"), (2, None), (3, "..."), (4, "alpha beta"), (5, long), (5, long), (None, "solo")], "item_id long, text string"
    )
    texts = ["alpha beta", "ALPHA-beta x", "alphabeta", None, "", "—", "x " * 100 + "alpha beta", "y " * 20 + long * 2, "ÀLPHA beta", "solo"]
    rows = decon.find(odd_docs(spark, *texts), items).select("doc_id", "found.*").orderBy("doc_id").collect()
    got = [(r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows]
    assert got == [
        (2, 2, ["1", "4"], True),
        (3, 2, ["1", "4"], True),
        (1, 0, [], False),
        (0, 0, [], False),
        (0, 0, [], False),
        (1, 0, [], False),
        (102, 2, ["1", "4"], False),
        (46, 26, ["5"], True),
        (2, 0, [], False),
        (1, 1, [""], True),
    ]
    assert decon.find(odd_docs(spark, "a").limit(0), items).count() == 0
    assert decon.find(odd_docs(spark, "alpha beta"), items.limit(0)).first().found.n_hit == 0


def test_spans_map_to_the_original_text():
    text = "«Ünter, ALPHA… beta!» alpha   Beta"
    machine = decon.automaton([("i", "alpha beta")])
    n, runs, ids = decon.scan(machine, text)
    assert (n, ids) == (6, {"i"})
    assert [text[a:b] for a, b in decon.spans(text, runs)] == ["alpha   Beta"]
