"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators are hashed n-grams of three kinds: runs of three bytes; one to three
consecutive token shapes (which kinds of characters a token holds, and whether
it repeats the token before it); and each shape with the power of two that its
share of all tokens falls to. Each indicator is scaled by its class log-count
ratio, a linear hinge-loss model is fitted by dual coordinate descent, and the
margin is turned into a probability on labelled rows kept apart for it.

Labels come from learnable rows only, at most `per_class` of either label,
chosen by a hash of the id. Whole texts are read when learning and scoring.

Cases: a null text counts as empty and gets the score of a text without any
indicator; rows without labels of both kinds cannot be learned from and give a
constant score; ties do not arise, since the score depends on the text alone and
repeated rows score alike; empty tables are fine; only named columns are read.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64
from tidemark.llm.learning import labelled_sample, platt, sigmoid, split_of

BITS = 18
PER_CLASS = 2500
#: Bytes of text turned to arrays at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_U = np.uint64
#: Kinds of bytes, one bit each: upper case, lower case, digit, beyond ASCII, full
#: stop or comma, exclamation or question mark, bar, other symbol, line end.
_KIND = np.zeros(256, np.uint16)
for _kind, _bytes in enumerate(
    [range(65, 91), range(97, 123), range(48, 58), range(128, 256), b".,;:", b"!?", b"|", b"#$%&*+/<=>@\\^_`{}~", b"\n\r"]
):
    _KIND[list(_bytes)] |= 1 << _kind


def _fold(x: np.ndarray) -> np.ndarray:
    return mix64(x) >> _U(64 - BITS)


def indicators(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct indicator numbers of each text."""
    raw = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(len(texts), dtype=_U), sizes)
    wide = raw.astype(_U)
    trigram = wide[:-2] | wide[1:-1] << _U(8) | wide[2:] << _U(16)
    inside = doc[:-2] == doc[2:]
    found = [doc[:-2][inside] << _U(BITS) | _fold(trigram[inside] + _U(1 << 32))]

    token = (raw != 32) & (raw != 10)
    edge = np.flatnonzero(np.diff(token, prepend=False))
    starts, stops = edge[::2], edge[1::2]
    if len(starts):
        owner = doc[starts]
        n = len(starts)
        lengths = stops - starts
        # A token's hash: sum of its bytes times powers by place.
        at = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
        power = np.cumprod(np.full(int(lengths.max()), 0x100000001B3, _U))
        word = np.add.reduceat(wide[token] * power[place], at)
        shape = np.bitwise_or.reduceat(_KIND[raw[token]], at).astype(_U)
        again = np.zeros(n, bool)
        again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        shape = shape * _U(2) + again.astype(_U) + _U(1)
        run = shape
        for width in (1, 2, 3):
            if width > 1:
                if n < width:
                    break
                run = run[:-1] * _U(0x9E3779B1) + shape[width - 1 :]
                same = owner[: n - width + 1] == owner[width - 1 :]
            else:
                same = np.ones(n, bool)
            found.append(owner[: len(run)][same] << _U(BITS) | _fold(run[same] * _U(4) + _U(width << 40)))
        pair, count = np.unique(owner << _U(16) | shape, return_counts=True)
        total = np.bincount(owner.astype(np.int64), minlength=len(texts))
        share = count / total[(pair >> _U(16)).astype(np.int64)]
        level = np.ceil(-np.log2(share)).astype(_U)
        found.append(pair >> _U(16) << _U(BITS) | _fold((pair & _U(0xFFFF)) * _U(64) + level + _U(9 << 40)))
    keys = np.sort(np.concatenate(found))
    keys = keys[np.diff(keys, prepend=_U(0xFFFFFFFFFFFFFFFF)) != 0] if len(keys) else keys
    cuts = np.searchsorted(keys >> _U(BITS), np.arange(len(texts) + 1, dtype=_U))
    low = (keys & _U((1 << BITS) - 1)).astype(np.int64)
    return [low[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _in_chunks(texts) -> Iterator[list[np.ndarray]]:
    chunk, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        if chunk and size + len(raw) > CHUNK_BYTES:
            yield indicators(chunk)
            chunk, size = [], 0
        chunk.append(raw)
        size += len(raw)
    if chunk:
        yield indicators(chunk)


def _packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([x.astype(np.int32).tobytes() for chunk in _in_chunks(part) for x in chunk], dtype=object)


def log_ratio(rows: list[np.ndarray], y: np.ndarray, size: int, smooth: float = 1.0) -> np.ndarray:
    """ln of the classes' normalised indicator counts, for each indicator."""
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for row, label in zip(rows, y):
        counts[int(label)][row] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows, values, y, cost, size: int, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Linear SVM with hinge loss by dual coordinate descent; the last weight is the bias.

    cost: upper bound of each row's dual variable.
    """
    w = np.zeros(size + 1)
    dual = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        moved = 0.0
        for i in order:
            sign = 1.0 if y[i] else -1.0
            gradient = sign * (w[rows[i]] @ values[i] + w[size]) - 1.0
            new = min(max(dual[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - dual[i]) * sign
            if step:
                w[rows[i]] += step * values[i]
                w[size] += step
                moved = max(moved, abs(step) / cost[i])
                dual[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Weights per indicator with the log-count ratio folded in, and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b

    def margin(self, row: np.ndarray) -> float:
        """Rows are scaled to unit length, so long texts do not outweigh short ones."""
        return float(self.weights[row].sum()) / max(1.0, len(row)) ** 0.5 + self.bias

    def scores(self, texts) -> np.ndarray:
        margins = [self.margin(row) for chunk in _in_chunks(texts) for row in chunk]
        return sigmoid(self.a * np.array(margins, dtype=float) + self.b)


def fit(keys, rows: list[np.ndarray], y: np.ndarray, cost: float = 1.0) -> Model:
    """Learn from indicator rows; a fifth of them, by key, calibrates."""
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size), 0.0, 1.0, float(np.log(p / (1 - p))))
    aside = split_of(keys)
    if any(len(set(part.tolist())) < 2 for part in (y[aside], y[~aside])):
        aside = np.zeros(len(y), bool)
    learn = [r for r, held in zip(rows, aside) if not held]
    target = y[~aside]
    ratio = log_ratio(learn, target, size)
    values = [ratio[r] / max(1.0, len(r)) ** 0.5 for r in learn]
    share = np.bincount(target, minlength=2) / len(target)
    costs = np.where(target > 0, cost / (2 * share[1]), cost / (2 * share[0]))
    w = dual_descent(learn, values, target, costs, size)
    model = Model(w[:size] * ratio, float(w[size]), 1.0, 0.0)
    check = [r for r, held in zip(rows, aside if aside.any() else ~aside) if held]
    margins = np.array([model.margin(r) for r in check])
    model.a, model.b = platt(margins, y[aside] if aside.any() else y)
    return model


def train(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="quality", per_class=PER_CLASS) -> Model:
    """Learn from at most per_class labelled rows of either class.

    Indicators are made in tasks; the driver gets at most 2 * per_class rows of
    at most 2 ** BITS numbers, whatever the lengths of the texts.
    """
    sample = labelled_sample(docs.select(key, text), labels, key, label, (0, 1), per_class)
    packed = F.pandas_udf(_packed, "binary")
    got = sample.select(F.col(key).alias("k"), "y", packed(F.col(text)).alias("x")).collect()
    got.sort(key=lambda r: (r["k"], r["y"], len(r["x"])))
    rows = [np.frombuffer(r["x"], dtype=np.int32) for r in got]
    return fit([r["k"] for r in got], rows, np.array([r["y"] for r in got], dtype=np.int64))


def score(spark, model: Model, text: Column) -> Column:
    """The probability of label 1 for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.scores(part))

    return scored(text)
