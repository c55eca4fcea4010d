"""Language identification with averaged hashed subword embeddings.

Text is lower-cased, every run of characters that are not letters becomes one
space, and each two, three and four consecutive characters of the result are a
subword, hashed into 2 ** BITS buckets. A text is the mean of its subwords'
embeddings, a linear softmax on top gives the languages, and both are trained
together by stochastic gradient descent. On texts kept apart, a temperature
calibrates the probabilities and a threshold is set below which a prediction
counts as rejected.

Learning uses text and language of learnable rows only, about `per_language` of
each language, chosen by a hash of the id. Whole texts are read.

Cases: a null text, or one without any letter, is `und` with score 0 and counts
as rejected; without learnable rows every text is `und`; an equal score goes to
the language first in alphabetical order; repeated rows are judged alike; empty
tables are fine; only the named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import learnable, mix64
from tidemark.llm.learning import split_of

BITS = 15
DIM = 12
SIZES = (2, 3, 4)
PER_LANGUAGE = 800
#: Share of right predictions, on texts kept apart, that rejection must leave accepted.
KEEP_RIGHT = 0.995
CHUNK_CHARS = 1 << 18
UNDETERMINED = "und"

_U = np.uint64
_letters = None


def _letter_table() -> np.ndarray:
    """Which code points are letters; built once per Python process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of its text) of all subwords, and per text whether it has letters."""
    lines = [" " + t.lower() + " " for t in texts]
    code = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    letter = _letter_table()[code]
    has = np.zeros(len(lines), bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    keep[:1] = True
    code, owner = np.where(letter, code, 32)[keep].astype(_U), owner[keep]
    buckets, owners = [], []
    for size in SIZES:
        n = len(code) - size + 1
        if n <= 0:
            break
        run = np.zeros(n, _U)
        for j in range(size):
            run = run * _U(0x110001) + code[j : j + n]
        same = owner[:n] == owner[size - 1 :]
        buckets.append((mix64(run[same] + _U(size << 60)) >> _U(64 - BITS)).astype(np.int32))
        owners.append(owner[:n][same].astype(np.int32))
    if not buckets:
        return np.empty(0, np.int32), np.empty(0, np.int32), has
    return np.concatenate(buckets), np.concatenate(owners), has


def _in_chunks(texts) -> Iterator[list[str]]:
    chunk, size = [], 0
    for text in texts:
        text = text or ""
        if chunk and size + len(text) > CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
        chunk.append(text)
        size += len(text)
    if chunk:
        yield chunk


def _counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Per text its distinct buckets and how often each occurs, packed: at most 2 ** BITS of them."""
    for part in texts:
        packed = []
        for chunk in _in_chunks(part):
            bucket, owner, _ = subwords(chunk)
            pair, n = np.unique(owner.astype(np.int64) << BITS | bucket, return_counts=True)
            cuts = np.searchsorted(pair >> BITS, np.arange(len(chunk) + 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                packed.append(np.stack([pair[a:b] & ((1 << BITS) - 1), n[a:b]]).astype(np.int32).tobytes())
        yield pd.Series(packed, dtype=object)


class Model:
    """Per bucket the logits of the languages (embedding times softmax weights), and the calibration."""

    def __init__(self, langs: list[str], logits: np.ndarray, bias: np.ndarray, temperature: float, least: float):
        self.langs, self.logits, self.bias = langs, logits.astype(np.float32), bias
        self.temperature, self.least = temperature, least

    def predict(self, texts) -> pd.DataFrame:
        langs, scores = [], []
        for chunk in _in_chunks(texts):
            bucket, owner, has = subwords(chunk)
            if not self.langs:
                langs += [UNDETERMINED] * len(chunk)
                scores += [0.0] * len(chunk)
                continue
            total = np.bincount(owner, minlength=len(chunk))
            mean = np.empty((len(chunk), len(self.langs)))
            for k in range(len(self.langs)):
                mean[:, k] = np.bincount(owner, weights=self.logits[bucket, k], minlength=len(chunk))
            p = softmax((mean / np.maximum(total, 1)[:, None] + self.bias) * self.temperature)
            best = p.argmax(axis=1)
            langs += [self.langs[b] if h else UNDETERMINED for b, h in zip(best, has)]
            scores += [float(p[i, b]) if has[i] else 0.0 for i, b in enumerate(best)]
        return pd.DataFrame({"lang": langs, "score": scores}, columns=["lang", "score"])


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=-1, keepdims=True))
    return z / z.sum(axis=-1, keepdims=True)


def fit(keys, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 11) -> Model:
    """Stochastic gradient descent over (buckets, counts) rows with their languages."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0), 1.0, 1.0)
    y = np.array([names.index(x) for x in langs])
    random = np.random.default_rng(seed)
    embed = random.uniform(-1, 1, (1 << BITS, DIM)) / DIM
    weights, bias = np.zeros((DIM, len(names))), np.zeros(len(names))
    aside = split_of(keys)
    order = np.flatnonzero(~aside) if (~aside).any() else np.arange(len(y))
    shares = [counts / max(1, counts.sum()) for _, counts in rows]
    steps, done = epochs * len(order), 0
    for _ in range(epochs):
        random.shuffle(order)
        for i in order:
            buckets, share = rows[i][0], shares[i]
            if not len(buckets):
                continue
            now = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[buckets]
            gradient = softmax(hidden @ weights + bias)
            gradient[y[i]] -= 1.0
            back = weights @ gradient
            weights -= now * np.outer(hidden, gradient)
            bias -= now * 0.1 * gradient
            # Embeddings move by the text's gradient in full, as each is one of many that share it.
            embed[buckets] -= now * np.outer(np.minimum(1.0, share * len(buckets)), back)
    check = np.flatnonzero(aside) if aside.any() else order
    z = np.array([shares[i] @ embed[rows[i][0]] @ weights + bias for i in check if len(rows[i][0])])
    truth = np.array([y[i] for i in check if len(rows[i][0])])
    temperature, least = 1.0, 0.0
    if len(truth):
        grid = np.geomspace(0.002, 5.0, 60)
        losses = [-np.log(np.maximum(softmax(z * t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
        p = softmax(z * temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        if len(right):
            least = float(right[int((1 - KEEP_RIGHT) * len(right))])
    return Model(names, embed @ weights, bias, temperature, least)


def train(docs: DataFrame, key="doc_id", text="text", lang="lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from about per_language texts of each language, or all if there are fewer.

    Languages are counted first; then a row is taken if the hash of its id falls
    into the share its language needs, which no task has to see other rows for and
    which exceeds the number asked for by chance only (a tenth more is very rare).
    Bucket counts are made in tasks and at most 2 ** BITS of them per text reach
    the driver.
    """
    known = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("y")).where(
        learnable(F.col("k")) & F.col("y").isNotNull()
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [], [])
    scale = 1 << 30
    share = F.create_map(*[F.lit(x) for y, n in sorted(sizes.items()) for x in (y, -(-scale * per_language // n))])
    counted = F.pandas_udf(_counted, "binary")
    chosen = known.where(F.pmod(F.xxhash64("k"), F.lit(scale)) < F.element_at(share, F.col("y")))
    got = chosen.where(F.col("t").isNotNull()).select("k", "y", counted(F.col("t")).alias("x")).collect()
    got.sort(key=lambda r: (r["k"], r["y"], len(r["x"])))
    rows = []
    for r in got:
        buckets, counts = np.frombuffer(r["x"], dtype=np.int32).reshape(2, -1)
        rows.append((buckets, counts.astype(np.float32)))
    return fit([r["k"] for r in got], rows, [r["y"] for r in got])


def predict(spark, model: Model, text: Column) -> Column:
    """A struct (lang, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield shared.value.predict(part)

    return predicted(text)


def accepted(model: Model, lang: Column, score: Column) -> Column:
    """False where the calibrated rejection refuses the prediction."""
    return (lang != UNDETERMINED) & (score >= F.lit(model.least))
