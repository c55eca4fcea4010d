"""Toxicity scoring behind noisy-channel deobfuscation.

Writers hide words by leetspeak (1d10t), spacing (i d i o t, i.d.i.o.t) and
repetition (idiooot). Each suspicious piece of text becomes a lattice: every
observed character, or run of one, offers the letters it may stand for, with a
cost for the channel. A Viterbi search under a character language model picks the
restoration with the least total cost; its states are the last three characters.
The language model interpolates hashed character 1- to 4-gram counts over all
documents of the corpus; the table's size is fixed, the counts grow with the input.
Words that hold nothing to restore have a lattice of one path and skip the search.

Restored words are scored by a lexicon of log odds learned from labelled rows, by
word and by word beginning; the document's score is a logistic function of the
number of words above several levels of log odds, fitted on labelled rows that the
lexicon has not seen.

Labels come from learnable rows only, at most `per_class` of either label, chosen
by a hash of the id. Whole texts are read, when learning and when scoring.

Cases: a null text counts as empty and scores like a text without toxic words;
without labels of both kinds the score is constant; of restorations with equal
cost the alphabetically first state wins; repeated rows score alike; empty tables are
fine; only the named columns are read.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64
from tidemark.llm.language import _in_chunks, _letter_table
from tidemark.llm.learning import labelled_sample, sigmoid, split_of

# Letters that digits and symbols commonly stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
#: Characters that may stand between the letters of one word.
SEPARATORS = " .-_*~'`,:;/\\^\u200b\u200c\u200d\u2060\u00ad\ufeff"
#: What a masking star may hide.
MASKED = "aeiou"
#: Costs of the channel, in nats.
LEET_COST, DROP_COST, BREAK_COST, MASK_COST, REPEAT_COST, KEEP_COST = 1.0, 0.5, 1.5, 2.5, 0.5, 2.0

LM_BITS, ORDER = 18, 4
MIXTURE = (0.03, 0.12, 0.3, 0.54)
PER_CLASS = 2500
#: Log odds from which words are counted.
LEVELS = (3.0, 4.0, 5.0, 6.0)
#: Doubled letters of a word up to which its readings are looked up before it is searched.
MOST_DOUBLES = 4
#: Words whose scores a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Log odds below which a lexicon entry is not kept: what a word or two seen once would get.
WEAK = 2.0

_U = np.uint64
_EDGE = ".,;:!?\"'()[]{}<>*#%&$…-–—_«»“”‘’|~"
_MARKS = ".,;:?\"'()[]{}…–—«»“”‘’"
_SPACED = re.compile(r"(?<!\S)(?:\S{1,2}\s+){2,}\S{1,2}(?!\S)")
_TRIPLE = re.compile(r"(.)\1\1", re.S)
_DOUBLE = re.compile(r"(.)\1+", re.S)


def _bucket(order: int, codes) -> int:
    """The LM table's bucket of an n-gram; the same as in `_gram_counts`."""
    x = 0
    for c in codes:
        x = (x * 0x110001 + c) & 0xFFFFFFFFFFFFFFFF
    x = (x + (order << 59)) & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 31)) >> (64 - LM_BITS)


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts of hashed character n-grams of the words of texts, one space around each word."""
    counts = np.zeros(1 << LM_BITS, np.int64)
    for chunk in _in_chunks(texts):
        code = np.frombuffer((" " + " ".join(chunk).lower() + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = _letter_table()[code]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        code = np.where(letter, code, 32)[keep].astype(_U)
        for order in range(1, ORDER + 1):
            n = len(code) - order + 1
            if n <= 0:
                break
            x = np.zeros(n, _U)
            for j in range(order):
                x = x * _U(0x110001) + code[j : j + n]
            counts += np.bincount((mix64(x + _U(order << 59)) >> _U(64 - LM_BITS)).astype(np.int64), minlength=1 << LM_BITS)
    return counts


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """N-gram counts over all documents: each task sums its own, Spark adds them up.

    At most 2 ** LM_BITS sums reach the driver, whatever the corpus.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << LM_BITS, np.int64)
        for frame in frames:
            total += gram_counts([t for t in frame["t"] if t])
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some.astype(np.int32), "n": total[some]})

    summed = docs.select(F.col(text).alias("t")).mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    got = summed.toArrow()
    table = np.zeros(1 << LM_BITS, np.int64)
    table[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return table


class Decoder:
    """Viterbi search over lattices under the language model."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.total = max(1, int(counts.sum()) // ORDER)
        self.known: dict[str, float] = {}

    def cost(self, context: str, char: str) -> float:
        """-ln of the probability of a character after up to three others."""
        gram = context[-(ORDER - 1) :] + char
        value = self.known.get(gram)
        if value is None:
            codes = [ord(c) for c in gram]
            p = 1e-7
            for order in range(1, len(codes) + 1):
                above = int(self.counts[_bucket(order, codes[-order:])])
                below = int(self.counts[_bucket(order - 1, codes[-order:-1])]) if order > 1 else self.total
                if above and below:
                    p += MIXTURE[order - 1] * min(1.0, above / below)
            value = -float(np.log(p))
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[gram] = value
        return value

    @staticmethod
    def options(char: str, run: int) -> list[tuple[str, float]]:
        """What a run of one observed character may stand for, with the channel's cost."""
        if char in LEET:
            out = [(x * n, LEET_COST + REPEAT_COST * (run > n)) for x in LEET[char] for n in {1, min(run, 2)}]
            return out + [(" ", BREAK_COST + KEEP_COST)]
        if char in SEPARATORS:
            drop = DROP_COST if char != " " else DROP_COST + 0.5
            out = [("", drop * min(run, 3)), (" ", 0.0 if char == " " else BREAK_COST)]
            return out + [(v, MASK_COST * run) for v in MASKED if char == "*"]
        if not char.isalpha():
            return [(" ", BREAK_COST), ("", BREAK_COST)]
        if run == 1:
            return [(char, 0.0)]
        out = [(char, REPEAT_COST), (char * 2, 0.0 if run == 2 else REPEAT_COST)]
        return out + [(char * run, KEEP_COST * (run - 2))] * (run > 2)

    def restore(self, observed: str) -> str:
        """The cheapest restoration of a piece of lower-cased text; words parted by single spaces."""
        best: dict[str, tuple[float, object]] = {" ": (0.0, None)}
        at = 0
        while at < len(observed):
            char = observed[at]
            stop = at
            while stop < len(observed) and observed[stop] == char:
                stop += 1
            options = self.options(char, stop - at)
            at = stop
            after: dict[str, tuple[float, object]] = {}
            for state, (cost, tail) in best.items():
                for letters, channel in options:
                    total, context, path = cost + channel, state, tail
                    for letter in letters:
                        if letter == " " and context[-1] == " ":
                            continue
                        total += self.cost(context, letter)
                        context = (context + letter)[-(ORDER - 1) :]
                        path = (letter, path)
                    held = after.get(context)
                    if held is None or total < held[0]:
                        after[context] = (total, path)
            best = after
        _, (_, path) = min((cost + (0.0 if state[-1] == " " else self.cost(state, " ")), (state, path)) for state, (cost, path) in _sorted(best))
        out = []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out)).strip()


def _sorted(best):
    """States by name, so that equal costs are settled the same way everywhere."""
    return [(state, best[state]) for state in sorted(best)]


def _features(word: str) -> tuple[int, int, int]:
    """Lexicon keys of a word: itself, and its beginnings of four and five letters (as far as it has them)."""
    marks = "=" + word, "4" + word[:4] if len(word) >= 4 else "=" + word, "5" + word[:5] if len(word) >= 5 else "=" + word
    return tuple(
        int.from_bytes(hashlib.blake2b(m.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1 for m in marks
    )


class Reader:
    """Turns texts into restored words and, given lexicon weights, into profiles."""

    def __init__(self, decoder: Decoder, weights: dict[int, float] | None = None):
        self.decoder, self.weights = decoder, weights
        self.words_of: dict[str, tuple[str, ...]] = {}
        self.value_of: dict[str, float] = {}

    def words(self, token: str) -> tuple[str, ...]:
        """The restored words of a lower-cased token without white space.

        Plain words stand for themselves. One with doubled letters, or with symbols at
        its ends that could be letters, is searched, too, and the lattice decides; what
        symbols stand for counts if the lexicon counts it.
        """
        core = token.strip(_EDGE)
        outer = token.strip(_MARKS)
        if not core.isalpha() or _TRIPLE.search(core):
            return tuple(self.decoder.restore(outer or token).split())
        if self.weights is not None:
            more = ()
            if _DOUBLE.search(core) and self._may_count(core):
                more = tuple(self.decoder.restore(core).split())
            if outer != core and not _TRIPLE.search(outer):
                more += tuple(w for w in self.decoder.restore(outer).split() if self._strength(w) > LEVELS[0])
            return (core, *more)
        return (core,)

    def _may_count(self, core: str) -> bool:
        """Whether any way to read the doubled letters of a word would count; else the search can't change a score."""
        doubles = list(_DOUBLE.finditer(core))
        if len(doubles) > MOST_DOUBLES:
            return True
        readings = [""]
        at = 0
        for m in doubles:
            readings = [r + core[at : m.start()] + m[1] * n for r in readings for n in (1, 2)]
            at = m.end()
        return any(self._strength(r + core[at:]) > LEVELS[0] for r in readings)

    def _strength(self, word: str) -> float:
        return max(self.weights.get(f, 0.0) for f in _features(word))

    def spaced(self, stretch: str) -> tuple[str, ...]:
        """The restored words of letters set apart, singly or in twos, read with their spaces and without."""
        pieces = stretch.split()
        read = self.decoder.restore(" ".join(pieces)).split()
        return tuple(dict.fromkeys(read + self.decoder.restore("".join(pieces)).split()))

    def tokens(self, text: str) -> list[tuple[str, ...]]:
        """Restored words of each distinct token and of each stretch of spaced letters."""
        low = text.lower()
        found = []
        for token in set(low.split()):
            words = self.words_of.get(token)
            if words is None:
                if len(self.words_of) >= REMEMBERED:
                    self.words_of.clear()
                words = self.words_of[token] = self.words(token)
            found.append(words)
        found += [self.spaced(m[0]) for m in _SPACED.finditer(low)]
        return found

    def _value(self, words: tuple[str, ...]) -> float:
        return max(map(self._strength, words), default=0.0)

    def profile(self, text: str) -> tuple[float, ...]:
        """The summary of a text's words."""
        low = text.lower()
        known = self.value_of
        values = []
        for token in set(low.split()):
            value = known.get(token)
            if value is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                value = known[token] = self._value(self.words(token))
            if value:
                values.append(value)
        values += [self._value(self.spaced(m[0])) for m in _SPACED.finditer(low)]
        return summary(values)


def summary(values: list[float]) -> tuple[float, ...]:
    """ln of 1 + number of words above each level of log odds.

    Several levels, as the odds that set toxic words apart from chance grow with
    the number of labelled rows, and the fit finds the levels that count.
    """
    return tuple(float(np.log1p(sum(v > level for v in values))) for level in LEVELS)


class Model:
    def __init__(self, counts: np.ndarray, weights: dict[int, float], theta: np.ndarray):
        self.counts, self.weights, self.theta = counts, weights, np.asarray(theta, float)

    def reader(self) -> Reader:
        return Reader(Decoder(self.counts), self.weights)

    def score(self, profile) -> float:
        return float(sigmoid(self.theta[:-1] @ np.asarray(profile) + self.theta[-1]))


def copies(rows: list[np.ndarray], functions: int = 16, agree: int = 9) -> np.ndarray:
    """For each row how many rows of the sample are near copies of it, itself included.

    Rows are sorted distinct keys. Two rows are near copies if that many of
    their minima under random functions agree; rows meet by pairs of minima.
    """
    salts = mix64(np.arange(1, functions + 1, dtype=_U))
    minima = np.zeros((len(rows), functions), _U)
    for k, row in enumerate(rows):
        if len(row):
            minima[k] = [mix64(row.astype(_U) + salt).min() for salt in salts]
    group = np.arange(len(rows))

    def top(k):
        while group[k] != k:
            group[k] = k = group[group[k]]
        return k

    for pair in range(0, functions, 2):
        first: dict[tuple, int] = {}
        for k, key in enumerate(map(tuple, minima[:, pair : pair + 2])):
            other = first.setdefault(key, k)
            if other != k and (minima[other] == minima[k]).sum() >= agree:
                group[top(k)] = top(other)
    tops = np.array([top(k) for k in range(len(rows))], dtype=np.int64)
    return np.bincount(tops, minlength=len(rows))[tops] if len(rows) else tops


def lexicon(rows: list[np.ndarray], y: np.ndarray, smooth: float = 0.5) -> dict[int, float]:
    """Log odds of each key's presence in documents of label 1 against label 0, above WEAK.

    Near copies share one vote, else the neutral words of a toxic text that was
    copied often would look toxic themselves.
    """
    votes = 1.0 / np.maximum(1, copies(rows))
    share = np.bincount(y, weights=votes, minlength=2) + 2 * smooth
    keys, where = np.unique(np.concatenate(rows), return_inverse=True)
    vote = np.repeat(votes, [len(r) for r in rows])
    label = np.repeat(y, [len(r) for r in rows])
    counts = [np.bincount(where[label == k], weights=vote[label == k], minlength=len(keys)) + smooth for k in (0, 1)]
    odds = np.log(counts[1] / share[1]) - np.log(counts[0] / share[0])
    return {int(k): float(v) for k, v in zip(keys[odds > WEAK], odds[odds > WEAK])}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, none negative, the intercept last; Newton steps.

    More evidence must not lower a score, so a feature whose weight comes out
    negative is left out and the others are fitted again.
    """
    use = list(range(x.shape[1]))
    while True:
        part = np.hstack([x[:, use], np.ones((len(x), 1))])
        theta = np.zeros(part.shape[1])
        for _ in range(100):
            p = sigmoid(part @ theta)
            gradient = part.T @ (weight * (p - y)) + ridge * theta
            hessian = (part * (weight * p * (1 - p))[:, None]).T @ part + ridge * np.eye(len(theta))
            step = np.linalg.solve(hessian, gradient)
            theta -= step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        if not use or theta[:-1].min() >= 0:
            full = np.zeros(x.shape[1] + 1)
            full[use], full[-1] = theta[:-1], theta[-1]
            return full
        use.pop(int(theta[:-1].argmin()))


def train(docs: DataFrame, labels: DataFrame, key="doc_id", text="text", label="toxic", per_class: int = PER_CLASS) -> Model:
    """Learn lexicon and score from at most per_class labelled rows of either class.

    Words are restored in tasks; of each chosen row the driver gets the lexicon
    keys of its distinct words, packed, and no text.
    """
    spark = docs.sparkSession
    counts = language_model(docs, text)
    shared = spark.sparkContext.broadcast(counts)
    sample = labelled_sample(docs.select(key, text), labels, key, label, (0, 1), per_class)

    @F.pandas_udf("binary")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(Decoder(shared.value))
        for part in texts:
            rows = []
            for t in part:
                words = sorted({w for ws in reader.tokens(t or "") for w in ws})
                rows.append(np.array([_features(w) for w in words], dtype=np.int64).tobytes())
            yield pd.Series(rows, dtype=object)

    got = sample.select(F.col(key).alias("k"), "y", read(F.col(text)).alias("x")).collect()
    got.sort(key=lambda r: (r["k"], r["y"], len(r["x"])))
    rows = [np.frombuffer(r["x"], dtype=np.int64).reshape(-1, 3) for r in got]
    return fit([r["k"] for r in got], rows, np.array([r["y"] for r in got], dtype=np.int64), counts)


def fit(keys, rows: list[np.ndarray], y: np.ndarray, counts: np.ndarray) -> Model:
    """The lexicon from four fifths of the rows, the score's weights from the rest."""
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(counts, {}, [0.0] * len(LEVELS) + [np.log(p / (1 - p))])
    aside = split_of(keys)
    if any(len(set(part.tolist())) < 2 for part in (y[aside], y[~aside])):
        learn, check = np.ones(len(y), bool), np.ones(len(y), bool)
    else:
        learn, check = ~aside, aside
    weights = lexicon([np.unique(r) for r, m in zip(rows, learn) if m], y[learn])
    x = []
    for row in (r for r, m in zip(rows, check) if m):
        values = [max(weights.get(f, 0.0) for f in word) for word in row.tolist()]
        x.append(summary([v for v in values if v]))
    target = y[check]
    share = np.bincount(target, minlength=2) / len(target)
    return Model(counts, weights, logistic(np.array(x), target, 0.5 / share[target]))


def score(spark, model: Model, text: Column) -> Column:
    """The probability of label 1 for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = shared.value.reader()
        for part in texts:
            yield pd.Series([shared.value.score(reader.profile(t or "")) for t in part], dtype=float)

    return scored(text)


def restored(spark, model: Model, text: Column) -> Column:
    """The text in lower case with every suspicious token replaced by its restoration."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def rewritten(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = shared.value.reader()
        for part in texts:
            yield pd.Series([None if t is None else rewrite(reader, t) for t in part], dtype=object)

    return rewritten(text)


def rewrite(reader: Reader, text: str) -> str:
    low = _SPACED.sub(lambda m: reader.decoder.restore(m[0]), text.lower())
    return re.sub(r"\S+", lambda m: " ".join(reader.words(m[0])[-1:] if m[0].strip(_EDGE).isalpha() else reader.words(m[0])), low)
