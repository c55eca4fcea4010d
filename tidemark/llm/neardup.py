"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Texts are folded to words (as in `decontaminate`) and to hashed shingles of five
consecutive words; a text of one to four words is one shingle. A shingle's weight
is 1 + ln(occurrences). ProbMinHash gives each shingle a Poisson process with its
weight as rate: each arrival falls into a random register, and the register keeps
the shingle that came first. Registers of two texts agree with the probability
Jaccard of their weighted shingles. Shingles whose next arrival lies beyond the
latest register minimum of their text stop early. Registers are banded; texts that
meet in a band are candidates, and a candidate pair is a link if the exact
Jaccard similarity of the two shingle sets is at least the threshold.

Scale. Texts with equal words are one row from the start, so copies cost nothing
later. A bucket never yields all its pairs, at most as many a round as it has
members. First each member is paired with the bucket's centre; verified links are
merged into components. Then members are paired with the bucket's weightiest text of
another component, the likely origin of others, and with the next component's. These
rounds are for speed and decide nothing: registers follow weights, links do not, and texts that
repeat their shingles differently may share no band. At last a prefix-filter join, exact
over all texts, finds every remaining link between different components. Its shingles
are ordered by hash, those common in a sample of texts last; the order affects speed
only. Its work is bounded by the pairs of texts of different components that share
one of their first shingles, which is quadratic where many such texts are hardly
less similar than the threshold. On request, rounds that pair near neighbours of sorted
buckets come before it; they move every text's buckets and sketches, which costs more than
the join saves on the tables at hand.

Cases: null and empty texts, and texts without words, are compared with nothing
and each is a class of its own; the class id is the smallest id in the class,
and null only if the class has no other id; rows repeated with the same id share
their class; a text of any length is used whole; an empty table gives an empty
result. Only the id and text columns are read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import folded, mix64, stored

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Bytes of text whose shingles are held as arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bits of the bitmap that tells which texts' shingle sets are wanted.
FILTER_BITS = 26
#: Places in a sorted bucket within which two texts are neighbours.
NEIGHBOURS = 8
#: Registers that neighbours must agree in to be verified in these rounds. Without repeated
#: shingles 64 of 80 do at the threshold, with them far fewer may; the exact join finds those links.
AGREE = 50
#: Rounds that pair members with a bucket's weightiest text.
CENTRAL_ROUNDS = 2
#: One in so many texts is sampled for the order of shingles; a shingle that COMMON_LEAST
#: sampled texts have comes after the others, for at most COMMON_MOST such shingles.
COMMON_SAMPLE, COMMON_LEAST, COMMON_MOST = 64, 4, 1 << 18
#: Bits of the bitmap that tells which shingles may be shared between components.
SHARED_BITS = 27

_U = np.uint64
_MIX = [_U(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Shingle hashes have 48 bits; the text's number in its chunk takes the upper 16.
_BITS = _U(48)
_LOW = _U((1 << 48) - 1)


def _chunks(lines, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, lines) of runs of folded texts of bounded size."""
    first, chunk, size = 0, [], 0
    for k, line in enumerate(lines):
        if chunk and (size + len(line) > limit or len(chunk) >= 60_000):
            yield first, chunk
            first, chunk, size = k, [], 0
        chunk.append(line)
        size += len(line) + 1
    if chunk:
        yield first, chunk


def shingle_keys(lines: list[bytes], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys, occurrences): a key is line number << 48 | shingle hash."""
    raw = np.frombuffer(b" ".join(lines) + b" ", dtype=np.uint8)
    word = raw != 32
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, _U), np.empty(0, np.int64)
    sizes = ends - starts
    at = np.cumsum(sizes) - sizes
    within = np.arange(int(sizes.sum())) - np.repeat(at, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), 0x100000001B3, _U))
    words = np.add.reduceat((raw[word].astype(_U) + _U(1)) * powers[within], at)
    words = mix64(words + sizes.astype(_U) * _MIX[0])
    offsets = np.cumsum([0] + [len(x) + 1 for x in lines[:-1]])
    line = np.searchsorted(offsets, starts, side="right") - 1
    n = len(words)
    total = np.zeros(n, _U)
    for j in range(width):
        if j < n:
            # Words beyond a short text's end add nothing, so its shingle is the text.
            same = np.zeros(n, bool)
            same[: n - j] = line[: n - j] == line[j:]
            part = np.zeros(n, _U)
            part[: n - j] = words[j:] * _MIX[j]
            total += np.where(same, part + _MIX[j], _U(0))
    counts = np.bincount(line, minlength=len(lines))
    firsts = np.cumsum(counts) - counts
    place = np.arange(n) - firsts[line]
    whole = (place + width <= counts[line]) | ((counts[line] < width) & (place == 0))
    keys = np.sort((line[whole].astype(_U) << _BITS) | (mix64(total[whole]) & _LOW))
    new = np.flatnonzero(np.diff(keys, prepend=keys[:1] + _U(1)))
    return keys[new], np.diff(np.append(new, len(keys)))


def registers(keys: np.ndarray, counts: np.ndarray, lines: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of every line: the shingle hash that arrived first in each register.

    All lines advance together, one arrival per shingle and round; a shingle
    leaves as soon as its arrival is later than all minima of its line.
    """
    best = np.full(lines * m, np.inf)
    seen = []
    line = (keys >> _BITS).astype(np.int64)
    shingle = keys & _LOW
    rate = 1.0 + np.log(counts)
    time = np.zeros(len(keys))
    turn = 0
    while len(shingle):
        noise = mix64(shingle + _U((turn + 1) * int(_MIX[0]) & 0xFFFFFFFFFFFFFFFF))
        time = time - np.log1p(-(noise >> _U(11)).astype(np.float64) * 2.0**-53) / rate
        register = line * m + (mix64(noise ^ _MIX[1]) % _U(m)).astype(np.int64)
        early = time < best[register]
        np.minimum.at(best, register[early], time[early])
        seen.append((register[early], time[early], shingle[early]))
        latest = best.reshape(lines, m).max(axis=1)
        on = time < latest[line]
        line, shingle, rate, time = line[on], shingle[on], rate[on], time[on]
        turn += 1
    out = np.zeros(lines * m, _U)
    for register, time, shingle in seen:
        won = time == best[register]
        out[register[won]] = shingle[won]
    return out.reshape(lines, m)


def band_keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, order) of each line and band.

    The bucket is a hash of the band's registers. The order holds eight bits of each
    of the next eight registers, the nearest first: sorted by it, texts that agree in
    many further registers stand side by side.
    """
    start = np.arange(BANDS) * ROWS
    keys = np.zeros((len(sig), BANDS), _U)
    order = np.zeros((len(sig), BANDS), _U)
    for j in range(ROWS):
        keys = mix64(keys * _MIX[2] + sig[:, start + j] + _MIX[j])
    for j in range(8):
        order = order << _U(8) | mix64(sig[:, (start + ROWS + j) % REGISTERS]) & _U(255)
    return mix64(keys + np.arange(BANDS, dtype=_U) * _MIX[3]).view(np.int64), order.view(np.int64)


def _node(line: bytes) -> int:
    """A text's number: 64 bits of a cryptographic hash of its words.

    Ten billion texts share a number with a probability of about one in a billion each.
    """
    return int.from_bytes(hashlib.blake2b(b" ".join(line.split()), digest_size=8).digest(), "big", signed=True)


def _signed(ranks: dict[int, int], threshold: float, texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for part in texts:
        rows = []
        for _, lines in _chunks(map(folded, part), CHUNK_BYTES):
            keys, counts = shingle_keys(lines)
            sig = registers(keys, counts, len(lines))
            bucket, order = band_keys(sig)
            sketch = (mix64(sig) & _U(255)).astype(np.uint8)
            bounds = np.searchsorted(keys >> _BITS, np.arange(len(lines) + 1, dtype=_U))
            values = (keys & _LOW).astype(np.int64)
            for k, (line, first, last) in enumerate(zip(lines, bounds[:-1], bounds[1:])):
                if first == last:
                    rows.append((None,) * 6)
                else:
                    first_tokens = prefix(values[first:last], ranks, threshold)
                    rows.append((_node(line), bucket[k], order[k], sketch[k].tobytes(), int(last - first), first_tokens))
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pd.DataFrame(
            {
                "node": pd.array(columns[0], dtype="Int64"),
                "buckets": pd.Series(columns[1], dtype=object),
                "orders": pd.Series(columns[2], dtype=object),
                "sketch": pd.Series(columns[3], dtype=object),
                "size": pd.array(columns[4], dtype="Int64"),
                "tokens": pd.Series(columns[5], dtype=object),
            }
        )


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, carry=()) -> DataFrame:
    """One row per row: key, node, buckets, orders, sketch, size, tokens, and the columns `carry` as they are.

    The number of the words (null, as all that follows, without words), band keys, a
    byte per register, the number of shingles, and the first of them in the common order.
    """
    shared = docs.sparkSession.sparkContext.broadcast({int(v): k for k, v in enumerate(common_shingles(docs, text))})

    @F.pandas_udf("node long, buckets array<long>, orders array<long>, sketch binary, size long, tokens array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _signed(shared.value, threshold, texts)

    return docs.select(F.col(key).alias("key"), *carry, sign(F.col(text)).alias("s")).select("key", "s.*", *carry)


def _position(node, key):
    """The bit of (node, key) in the filter; the same in SQL and in numpy (`_positions`)."""
    return F.shiftrightunsigned(node.bitwiseXOR(F.shiftleft(F.coalesce(key, F.lit(-1)), 64 - FILTER_BITS)), 64 - FILTER_BITS)


def _positions(nodes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return (nodes.view(_U) ^ (keys.view(_U) << _U(64 - FILTER_BITS))) >> _U(64 - FILTER_BITS)


def bit_filter(wanted: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** FILTER_BITS bits with those of all wanted (node, key) rows set.

    Whatever the corpus, at most 2 ** FILTER_BITS / 64 words reach the driver. A
    full bitmap would let all texts through, which costs time and changes nothing.
    """
    position = _position(F.col("node"), F.col("key"))
    words = wanted.groupBy(F.shiftright(position, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(63).cast("int"))).alias("bits")
    )
    got = words.toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy()
    return bitmap.view(_U)


def shingle_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(node, shingles) for each row of `wanted` (node, key).

    Texts are read in place, never shuffled: a bitmap lets through those that may
    be wanted, and only their sets go to the join that decides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted))

    @F.pandas_udf("node long, shingles array<long>")
    def make(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        bitmap = shared.value
        for ids, texts in parts:
            lines = [folded(t) for t in texts]
            nodes = np.array([_node(x) for x in lines], dtype=np.int64)
            at = _positions(nodes, ids.to_numpy(dtype=np.int64))
            hit = (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
            sets: list = [None] * len(lines)
            where = np.flatnonzero(hit)
            for first, chunk in _chunks([lines[k] for k in where], CHUNK_BYTES):
                keys, _ = shingle_keys(chunk)
                bounds = np.searchsorted(keys >> _BITS, np.arange(len(chunk) + 1, dtype=_U))
                values = (keys & _LOW).astype(np.int64)
                for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    sets[where[first + k]] = values[a:b]
            yield pd.DataFrame({"node": nodes, "shingles": sets}, columns=["node", "shingles"])

    found = docs.select(F.col(key).cast("long").alias("k"), make(F.coalesce(F.col(key).cast("long"), F.lit(-1)), F.col(text)).alias("s"))
    found = found.select("k", "s.node", "s.shingles").where("shingles IS NOT NULL")
    asked = wanted.select(F.col("node").alias("n"), "key")
    same = (F.col("node") == F.col("n")) & F.col("k").eqNullSafe(F.col("key"))
    return found.join(asked, same, "left_semi").select("node", "shingles")


def common_shingles(docs: DataFrame, text: str) -> np.ndarray:
    """Shingles that many texts of a sample have, from rare to frequent; at most COMMON_MOST reach the driver."""

    @F.pandas_udf("array<long>")
    def make(texts: pd.Series) -> pd.Series:
        sets: list = []
        for _, chunk in _chunks(map(folded, texts), CHUNK_BYTES):
            keys, _ = shingle_keys(chunk)
            bounds = np.searchsorted(keys >> _BITS, np.arange(len(chunk) + 1, dtype=_U))
            sets += [(keys[a:b] & _LOW).astype(np.int64) for a, b in zip(bounds[:-1], bounds[1:])]
        return pd.Series(sets, dtype=object)

    some = docs.where(F.pmod(F.xxhash64(text), F.lit(COMMON_SAMPLE)) == 0).select(text).distinct()
    counted = some.select(F.explode(make(F.col(text))).alias("token")).groupBy("token").count()
    most = counted.where(F.col("count") >= COMMON_LEAST).orderBy(F.desc("count"), "token").limit(COMMON_MOST).toArrow()
    return most["token"].to_numpy()[::-1].astype(np.int64)


def prefix(values: np.ndarray, ranks: dict[int, int], threshold: float) -> np.ndarray:
    """The first shingles of a set, of which two sets with the similarity asked for share one at least.

    Such sets share at least threshold * n of either's n shingles, so that in any
    order the first n - ceil(threshold * n) + 1 of each have one in common.
    """
    rank = np.array([ranks.get(v, -1) for v in values.tolist()], dtype=np.int64)
    length = len(values) - int(np.ceil(threshold * len(values) - 1e-9)) + 1
    return values[np.lexsort((values, rank))][:length]


def _token_bits(tokens: DataFrame) -> np.ndarray:
    """A bitmap with the bits of all tokens set; at most 2 ** SHARED_BITS / 64 words reach the driver."""
    position = F.col("token").bitwiseAND((1 << SHARED_BITS) - 1)
    words = tokens.groupBy(F.shiftright(position, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), position.bitwiseAND(63).cast("int"))).alias("bits")
    )
    got = words.toArrow()
    bitmap = np.zeros(1 << SHARED_BITS - 6, np.int64)
    bitmap[got["word"].to_numpy()] = got["bits"].to_numpy()
    return bitmap.view(_U)


def remaining_pairs(first: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of different parts that share a token and may be links, from a (node, size, tokens) row per text.

    Nothing that could be a link is left out. Tokens of one part only go before the
    join, and of a token's largest part no member meets another, so a large
    component costs what its shared tokens with other components cost.
    """
    parts = first.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    spread = parts.select("part", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    live = stored(spread.where("low != high").select("token"))
    bits = first.sparkSession.sparkContext.broadcast(_token_bits(live))

    @F.pandas_udf("array<struct<token: long, place: int>>")
    def maybe(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bitmap = bits.value
        for part in sets:
            rows = []
            for tokens in part:
                at = tokens & ((1 << SHARED_BITS) - 1)
                hit = np.flatnonzero(bitmap[at >> 6] >> (at & 63).view(_U) & _U(1))
                rows.append([{"token": t, "place": k} for t, k in zip(tokens[hit].tolist(), hit.tolist())])
            yield pd.Series(rows, dtype=object)

    cut = F.size("tokens").alias("cut")
    rows = parts.select("node", "part", "size", cut, F.explode(maybe("tokens")).alias("t")).select("node", "part", "size", "cut", "t.*")
    rows = stored(rows.join(live, "token", "left_semi"))
    counts = rows.groupBy("token", "part").agg(F.count("*").alias("n"))
    main = stored(counts.groupBy("token").agg(F.max_by("part", F.struct("n", "part")).alias("main")))
    rows = rows.join(main, "token").withColumn("in_main", F.col("part") == F.col("main")).drop("main")
    left = rows.where("NOT in_main").select("token", *(F.col(c).alias(c + "_a") for c in ("node", "part", "size", "cut", "place")))
    right = rows.select("token", *(F.col(c).alias(c + "_b") for c in ("node", "part", "size", "cut", "place", "in_main")))
    na, nb, ka, kb = map(F.col, ("size_a", "size_b", "place_a", "place_b"))
    least = (na + nb) * threshold / (1 + threshold) - 1e-6
    # What two sets share lies before both places, at them, or behind.
    most = F.least(ka, kb) + F.least(na - ka, nb - kb)
    able = (F.least(na, nb) >= F.greatest(na, nb) * threshold - 1e-6) & (most >= least)
    once = F.col("in_main_b") | (F.col("node_a") < F.col("node_b"))
    met = left.join(right, "token").where((F.col("part_a") != F.col("part_b")) & once & able)
    # Up to the end of the prefix that ends first all shared shingles are shared tokens; behind it there are as many as are left.
    behind = F.greatest(na - F.col("cut_a"), nb - F.col("cut_b"))
    pairs = met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(
        F.count("*").alias("shared"), F.first(least - behind).alias("needed")
    )
    return pairs.where("shared >= needed").select("a", "b")


def in_buckets(texts: DataFrame, *columns: str) -> DataFrame:
    """(bucket, node, ...) for each band of texts that have one row each; of `orders` each band has its own, as `order`."""
    kept = [c for c in columns if c != "orders"]
    if "orders" not in columns:
        return texts.select(F.explode("buckets").alias("bucket"), "node", *kept)
    banded = texts.select("node", *kept, F.explode(F.arrays_zip("buckets", "orders")).alias("z"))
    return banded.select(F.col("z.buckets").alias("bucket"), F.col("z.orders").alias("order"), "node", *kept)


def star_pairs(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of each member with its bucket's centre, from (bucket, node) rows.

    The centre is the member with the smallest hash, the same one in most buckets
    that a group of near copies shares, so a group yields few distinct pairs.
    """
    centre = (
        members.groupBy("bucket")
        .agg(F.min_by("node", F.xxhash64("node")).alias("centre"), F.count("*").alias("n"))
        .where("n > 1")
        .select("bucket", "centre")
    )
    return (
        members.join(centre, "bucket")
        .where("node != centre")
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .distinct()
    )


def centrality(members: DataFrame) -> DataFrame:
    """(node, weight): how many members all buckets of a node have together.

    The text from which others were copied keeps its registers where they lost
    some, so it is in the fullest buckets and has the greatest weight among them.
    """
    full = members.groupBy("bucket").agg(F.count("*").alias("n"))
    return members.join(full, "bucket").groupBy("node").agg(F.sum("n").alias("weight"))


def central_pairs(members: DataFrame, used: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, centres): each member with its bucket's weightiest one, if that belongs to another part.

    members: (bucket, part, node, weight). Parts that were centres of their bucket
    before, `used` (bucket, part), have had their turn. Pairs are distinct.
    """
    free = members if used is None else members.join(used, ["bucket", "part"], "left_anti")
    top = free.groupBy("bucket").agg(
        F.max_by(F.struct("node", "part"), F.struct("weight", F.xxhash64("node"))).alias("top")
    )
    pairs = (
        members.join(top, "bucket")
        .where(F.col("part") != F.col("top.part"))
        .select(F.least("node", "top.node").alias("a"), F.greatest("node", "top.node").alias("b"))
        .distinct()
    )
    return pairs, top.select("bucket", F.col("top.part").alias("part"))


def _side_by_side(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = np.empty((0, 3), np.int64)
    sketches = np.empty((0, REGISTERS), np.uint8)
    for frame in frames:
        seen = len(rows[-NEIGHBOURS:])
        rows = np.vstack([rows[-NEIGHBOURS:], frame[["bucket", "part", "node"]].to_numpy(dtype=np.int64)])
        fresh = np.frombuffer(b"".join(map(bytes, frame["sketch"])), np.uint8).reshape(-1, REGISTERS)
        sketches = np.vstack([sketches[-NEIGHBOURS:], fresh])
        pairs = []
        for k in range(1, NEIGHBOURS + 1):
            late = np.arange(max(k, seen), len(rows))
            late = late[(rows[late, 0] == rows[late - k, 0]) & (rows[late, 1] != rows[late - k, 1])]
            late = late[(sketches[late] == sketches[late - k]).sum(axis=1) >= AGREE]
            pairs.append(np.stack([rows[late, 2], rows[late - k, 2]], axis=1))
        found = np.sort(np.concatenate(pairs), axis=1)
        yield pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})


def neighbour_pairs(members: DataFrame, salt: int) -> DataFrame:
    """Distinct pairs of near neighbours of different parts, from (bucket, order, part, node, sketch) rows.

    Sorted by bucket and order, the most similar members of a bucket are
    neighbours; the salt turns the order around without parting similar ones. Rows
    are dealt by ranges of bucket and order, so a bucket of any size spreads over
    many tasks, and yields at most NEIGHBOURS pairs for each member, without those
    whose registers rule a link out. Where a range ends inside a bucket some
    neighbours are passed over; the other bands and rounds have theirs elsewhere.
    """
    turned = members.withColumn("order", F.col("order").bitwiseXOR(F.xxhash64(F.lit(salt))))
    dealt = turned.repartitionByRange("bucket", "order").sortWithinPartitions("bucket", "order", "node")
    return dealt.mapInPandas(_side_by_side, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity asked for."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    near = F.least(na, nb) >= F.greatest(na, nb) * threshold
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").where(near)
    return joined.select("a", "b", (both / (na + nb - both)).alias("similarity")).where(F.col("similarity") >= threshold)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for nodes of edges (a, b): label is the smallest node connected.

    Each turn sends every vertex to its smallest neighbour (or itself) and
    contracts the edges accordingly; as nodes are hashes, their order is random
    and the edges vanish within a logarithmic number of turns.
    """
    edges = stored(edges.select("a", "b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        if labels is None:
            labels = to.withColumnsRenamed({"a": "node", "to": "label"})
        else:
            labels = labels.join(to, F.col("label") == F.col("a"), "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
        first = to.select("a", F.col("to").alias("x"))
        second = to.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = stored(
            edges.join(first, "a")
            .join(second, "b")
            .where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stored(labels)


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
    max_rounds: int | None = None,
    carry: tuple = (),
    neighbours: bool = False,
) -> DataFrame:
    """(key, class_id, class_size, kept): one row per row of docs.

    Columns of docs named in `carry` are added, and with them `part`, a number that
    the rows of a class share (null without words), as classes without ids have no other.
    kept marks the row that carries the class id, or every row of a class
    without ids. max_rounds is for experiments; by default the exact join settles what
    the rounds leave. With `neighbours` rounds of neighbours come first, until one
    merges nothing: they move every text's buckets, which the join seldom needs.
    """
    signed = stored(signatures(docs, key, text, threshold, carry).withColumn("row", F.monotonically_increasing_id()))
    worded = signed.where("node IS NOT NULL")
    keys = worded.groupBy("node").agg(F.min("key").alias("key"))
    # Copies have the same of everything but the key; one row stands for them.
    first = worded.groupBy("node").agg(F.min("row").alias("row")).select("row")
    of_neighbours = [] if neighbours else ["orders", "sketch"]
    texts = stored(worded.drop("key", *of_neighbours).join(first, "row", "left_semi").drop("row"))
    tested = stored(star_pairs(in_buckets(texts)))
    ends = stored(tested.select(F.col("a").alias("node")).union(tested.select("b")).distinct())
    sets = stored(shingle_sets(docs, keys.join(ends, "node", "left_semi"), key, text))
    labels = components(verified(tested, sets, threshold))
    # From here on only texts that met another one matter; a row each, buckets side by side.
    met = texts.drop("size", "tokens").join(ends, "node", "left_semi")
    met = stored(met.join(centrality(in_buckets(met)), "node"))
    turn, used = 1, None
    while max_rounds is None or turn < max_rounds:
        parted = met.join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
        if turn <= CENTRAL_ROUNDS:
            pairs, centres = central_pairs(in_buckets(parted, "part", "weight"), used)
            used = stored(centres)
        elif neighbours:
            pairs = neighbour_pairs(in_buckets(parted, "part", "orders", "sketch"), turn)
        else:
            break
        fresh = stored(pairs.join(tested, ["a", "b"], "left_anti"))
        tested = tested.unionByName(fresh)
        found = stored(verified(fresh, sets, threshold))
        if found.isEmpty() and turn > CENTRAL_ROUNDS:
            break
        if not found.isEmpty():
            # New links join components, so all links so far decide the labels anew.
            old = labels.select(F.least("node", "label").alias("a"), F.greatest("node", "label").alias("b")).where("a != b")
            labels = components(old.unionByName(found.select("a", "b")))
        turn += 1
    if max_rounds is None:
        rest = remaining_pairs(texts.select("node", "size", "tokens"), labels, threshold)
        rest = stored(rest.join(tested, ["a", "b"], "left_anti"))
        fresh = rest.select(F.col("a").alias("node")).union(rest.select("b")).distinct()
        fresh = stored(fresh.join(ends, "node", "left_anti"))
        if not fresh.isEmpty():
            sets = sets.unionByName(stored(shingle_sets(docs, keys.join(fresh, "node", "left_semi"), key, text)))
        found = stored(verified(rest, sets, threshold))
        if not found.isEmpty():
            old = labels.select(F.least("node", "label").alias("a"), F.greatest("node", "label").alias("b")).where("a != b")
            labels = components(old.unionByName(found.select("a", "b")))
    named = signed.select("key", "node", *carry).join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    # Stored, so that the join below is one of two plain shuffles, in which a class of a third of all rows can be split.
    sizes = stored(
        named.where("part IS NOT NULL").groupBy("part").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size"))
    )
    return named.join(sizes, "part", "left").select(
        F.col("key").alias(key),
        F.when(F.col("part").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("part").isNull() | F.col("key").eqNullSafe(F.col("class_id"))).alias("kept"),
        *([*carry, "part"] if carry else []),
    )
