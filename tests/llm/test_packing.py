import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import DATA, SMALL, odd_docs, read
from tidemark.llm import packing

WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

ODD = [
    "", " ", "\n\n a\t\tb \r\n", "it's we'll 'S I'm", "a<|endoftext|>b", " 　 x\x85y\x1cz​", "日本語 テキスト 한국어",
    "🙂🙂 family 👩‍👩‍👧", "x" * 5000, "áé ½ ² Ⅷ", "1234567890 12.5%", "\x00\x01", "ﬁ ſ K", "مرحبا بالعالم",
]


def ids_of(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_encoder_equals_the_vocabulary_file():
    encode = packing.encoder()
    for text in ODD + read("documents", SMALL)["text"].tolist():
        assert list(encode(text)) == ids_of(text), text[:80]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (1024, [(0, 1024)]), (1025, [(0, 1), (1, 1024)]), (2048, [(0, 1024), (1024, 1024)])])
def test_cut(n, want):
    assert packing.cut(n) == want


def naive_best_fit_decreasing(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 100, 1024])
    lengths = [min(capacity, 1 + int(rng.random() ** rng.choice([1, 2, 4]) * capacity)) for _ in range(rng.randrange(1, 600))]
    lengths += [capacity // 3 + 1] * rng.randrange(200)
    moves, bins = packing.plan(dict(Counter(lengths)), capacity)
    rooms, ranks = [capacity] * bins, defaultdict(set)
    for length, rank, per, n, first, offset in moves.tolist():
        for k in range(n):
            assert rooms[first + k] == capacity - offset
            rooms[first + k] -= per * length
            ranks[length].update(range(rank + k * per, rank + (k + 1) * per))
    assert {k: len(v) for k, v in ranks.items()} == dict(Counter(lengths))
    assert Counter(rooms) == naive_best_fit_decreasing(lengths, capacity)


def check(rows, docs, capacity=1024):
    """Pieces rebuild every document, and sequences are gapless and within capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(docs)
    for doc_id, text in docs.items():
        ids = np.array(ids_of(text or "") + [2], dtype="<u4")
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.length) == (k, *packing.cut(len(ids))[k])
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert r.start + r.length == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    lengths = [r.length for r in rows]
    assert len(by_sequence) == sum(naive_best_fit_decreasing(lengths, capacity).values())


def test_whole_table(spark):
    docs = read("documents", DATA)
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    check(packing.pack(packing.pieces(frame)).collect(), dict(zip(docs["doc_id"], docs["text"])))


def test_edges(spark):
    texts = [*ODD, None, "", "same", "same"]
    rows = packing.pack(packing.pieces(odd_docs(spark, *texts))).collect()
    check(rows, dict(enumerate(texts)))
    twice = packing.pack(packing.pieces(odd_docs(spark, "a", "a", "b", ids=[1, 1, None]))).collect()
    assert sorted(r.offset for r in twice) == [0, 2, 4] and len({r.sequence_id for r in twice}) == 1
    assert packing.pack(packing.pieces(odd_docs(spark, "a").limit(0))).count() == 0


def test_ids_on_request(spark):
    rows = packing.pieces(odd_docs(spark, "x y " * 2000), with_ids=True).orderBy("piece").collect()
    assert [i for r in rows for i in r.ids] == ids_of("x y " * 2000) + [2]
