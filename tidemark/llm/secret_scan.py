"""Secret scanning: fixed patterns, and a character CNN over every candidate in its context.

The patterns give base findings of three kinds. Whatever else could be a secret is a
candidate: runs of eight or more characters of key material, without what base findings
take of them, unless they are ordinary words and separators only (each word of up to
`LONGEST_WORD` letters, in lower case, capitalised or in capitals). A small convolutional network
reads candidates with the characters around them, in windows that overlap by half, so
that every stretch of up to `STEP` characters of a candidate of any length is whole in
one of them; the greatest probability counts.

The network learns, in numpy, from labelled findings: the material of base findings of
learnable rows is labelled 1, other candidates 0, and so are chains of a text's own words.
Each positive is shown as found, in a context from elsewhere in the text, without its name,
and inside a chain of words, as in a path; the latter two also in other letters, as
the patterns may know one alphabet only. So the network must judge the material itself.
Its probability is calibrated on findings kept apart, and the threshold is the highest that
still has the demanded recall there. Findings of the network add to the base findings and
never replace them.

Learning reads at most `max_findings` findings of either label, chosen by a hash of
id and place. Texts are scanned whole.

Cases: a null text counts as empty; overlapping findings of different kinds are all
kept, and no finding of the network reaches into a base finding; without
findings of both labels nothing is added; repeated rows are judged alike; empty
tables are fine; only the named columns are read. Offsets count code points.
"""

import hashlib
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import learnable
from tidemark.llm.learning import platt, sigmoid

KINDS = ("assign", "access", "hex", "cnn")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: What the names have in common with a lower-cased text; texts without it are not searched.
_HINTS = ("passw", "secret", "token", "api")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=@-]{8,}")
#: A word as texts have them; a candidate of such words and separators is none.
LONGEST_WORD = 20
_WORD = rf"(?:[A-Z]?[a-z]{{0,{LONGEST_WORD}}}|[A-Z]{{1,{LONGEST_WORD}}})"
_PLAIN = re.compile(rf"{_WORD}(?:[+/_.=@-]+{_WORD})*")
_ANY_WORD = re.compile(r"[A-Za-z]{3,12}")
_JOINTS = "/.=-_"
#: Letters that material is rewritten in.
_ALPHABETS = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

MAX_FINDINGS = 2000
RECALL = 0.99
#: Characters shown to the network: context, a stretch of the candidate, context.
CONTEXT, INNER = 16, 32
#: Stretches of a long candidate begin so many characters apart.
STEP = INNER // 2
LENGTH = 2 * CONTEXT + INNER
LEAST = 8
FILTERS, WIDTH, DIM = 24, 5, 10
#: Ways in which a positive is shown: as found, moved and in a chain, the latter in both letters.
FORMS = 5


def base_findings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' matches; leftmost, not overlapping within a kind."""
    found = []
    lower = text.lower()
    if any(hint in lower for hint in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return in_order(found)


def in_order(found):
    return sorted(found, key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def values(text: str) -> list[tuple[int, int]]:
    """The key material of the base findings, without the names it is assigned to."""
    found = []
    for start, end, kind in base_findings(text):
        found.append(_ASSIGN.match(text, start, end).span(2) if kind == "assign" else (start, end))
    return found


def candidates(text: str, base) -> list[tuple[int, int]]:
    """What could be a secret beside the base findings: parts of tokens that are more than ordinary words."""
    found = []
    taken = sorted((a, b) for a, b, _ in base)
    for m in _CANDIDATE.finditer(text):
        at, end = m.span()
        for a, b in taken:
            if a < end and b > at:
                found.append((at, a))
                at = max(at, b)
        found.append((at, end))
    return [(a, b) for a, b in found if b - a >= LEAST and not _PLAIN.fullmatch(text, a, b)]


def stretches(start: int, end: int) -> list[tuple[int, int]]:
    """The overlapping parts in which a candidate is shown, all of it in some."""
    last = max(start, end - INNER)
    return [(at, min(end, at + INNER)) for at in [*range(start, last, STEP), last]]


def window(text: str, start: int, end: int) -> str:
    """The characters shown for a stretch, always LENGTH of them."""
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    return before.rjust(CONTEXT, "\0") + text[start:end].ljust(INNER, "\0") + after.ljust(CONTEXT, "\0")


def encode(windows: list[str]) -> np.ndarray:
    """Character numbers 0 to 127; all characters beyond ASCII are one."""
    raw = np.frombuffer("".join(windows).encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.minimum(raw, 127).astype(np.int64).reshape(len(windows), LENGTH)


class Network:
    """Embedding, one convolution with ReLU, maximum over places, logistic output."""

    def __init__(self, seed: int = 5):
        random = np.random.default_rng(seed)
        self.embed = random.normal(0, 0.5, (128, DIM))
        self.kernel = random.normal(0, (2 / (WIDTH * DIM)) ** 0.5, (WIDTH * DIM, FILTERS))
        self.shift = np.zeros(FILTERS)
        self.out = random.normal(0, 0.1, FILTERS)
        self.bias = 0.0
        self.a, self.b, self.least = 1.0, 0.0, 2.0

    def _forward(self, x: np.ndarray):
        e = self.embed[x]
        places = LENGTH - WIDTH + 1
        patches = np.concatenate([e[:, j : j + places] for j in range(WIDTH)], axis=2)
        maps = patches @ self.kernel + self.shift
        best = maps.argmax(axis=1)
        top = np.take_along_axis(maps, best[:, None, :], axis=1)[:, 0]
        pooled = np.maximum(top, 0.0)
        return patches, best, top, pooled, pooled @ self.out + self.bias

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[k : k + 256])[4] for k in range(0, len(x), 256)] or [np.empty(0)])

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.margins(x) + self.b)

    def _step(self, x, y, weight, rate):
        patches, best, top, pooled, margin = self._forward(x)
        error = weight * (sigmoid(margin) - y) / len(x)
        back = np.outer(error, self.out) * (top > 0)
        rows = np.arange(len(x))
        kernel = np.zeros_like(self.kernel)
        embed = np.zeros_like(self.embed)
        for f in range(FILTERS):
            kernel[:, f] = back[:, f] @ patches[rows, best[:, f]]
            for j in range(WIDTH):
                part = self.kernel[j * DIM : (j + 1) * DIM, f]
                np.add.at(embed, x[rows, best[:, f] + j], back[:, f, None] * part)
        self.out -= rate * (pooled.T @ error)
        self.bias -= rate * error.sum()
        self.kernel -= rate * kernel
        self.shift -= rate * back.sum(axis=0)
        self.embed -= rate * embed

    def fit(self, x, y, epochs: int = 12, rate: float = 1.0, seed: int = 9):
        random = np.random.default_rng(seed)
        share = np.bincount(y, minlength=2) / len(y)
        weight = 0.5 / share[y]
        order = np.arange(len(y))
        for epoch in range(epochs):
            random.shuffle(order)
            for at in range(0, len(order), 32):
                part = order[at : at + 32]
                self._step(x[part], y[part], weight[part], rate * (1 - epoch / epochs))
        return self

    def calibrate(self, x, y, recall: float = RECALL):
        margins = self.margins(x)
        self.a, self.b = platt(margins, y)
        positive = np.sort(sigmoid(self.a * margins[y == 1] + self.b))
        self.least = float(positive[int((1 - recall) * len(positive))])
        return self


def _hash(*of) -> int:
    return int.from_bytes(hashlib.blake2b(":".join(map(str, of)).encode(), digest_size=7).digest(), "big")


def _chain(text: str, pick: int, value: str = "") -> str:
    """Words of the text around a place, joined as paths and names are, about a value."""
    at = pick // 3 % len(text)
    words = _ANY_WORD.findall(text[max(0, at - 200) : at + 200]) or ["x"]
    joint = _JOINTS[pick // 11 % len(_JOINTS)]
    lead, trail = ([words[pick // k % len(words)] for k in ks] for ks in ((13, 17, 19), (23, 29)))
    return joint.join([*lead, *([value] if value else []), *trail])


def _rewritten(value: str, pick: int) -> str:
    """Another value of the same kind: a part of it, in other letters."""
    noise = hashlib.blake2b(f"{pick}".encode(), digest_size=min(64, LEAST * 2 + pick % 25)).digest()
    letters = _ALPHABETS[pick // 5 % 4 == 0]
    return "".join(letters[x % len(letters)] for x in noise[: max(LEAST * 2, len(value))])


def _shown(text: str, start: int, end: int, form: int, pick: int) -> str:
    """A window of key material: as it stands, on its own elsewhere in the text, or inside a chain of its words."""
    value = text[start:end]
    if form == 0:
        parts = stretches(start, end)
        return window(text, *parts[pick // 7 % len(parts)])
    if form % 2 == 0:
        value = _rewritten(value, pick)
    made, first, last = _placed(text, value if form < 3 else _chain(text, pick, value), pick)
    own = made.index(value, first)
    # Stretches that hold most of the value, as one of them does when a text is scanned.
    most = min(len(value), STEP)
    parts = [p for p in stretches(first, last) if min(p[1], own + len(value)) - max(p[0], own) >= most]
    return window(made, *parts[pick // 7 % len(parts)])


def _placed(text: str, token: str, pick: int) -> tuple[str, int, int]:
    """(text around a token at some place of a text, where the token begins and ends)."""
    at = pick // 3 % len(text)
    before = text[max(0, at - CONTEXT) : at] + " "
    return f"{before}{token} {text[at : at + CONTEXT]}", len(before), len(before) + len(token)


def _labelled(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """Windows of a text's labelled findings with a hash that chooses among them; `made` ones stand in no text."""
    out = []
    for doc_id, text in zip(ids, texts):
        rows = []
        if text:
            for (start, end), form in product(values(text), range(FORMS)):
                pick = _hash(doc_id, start, form, 1)
                rows.append({"pick": pick, "y": 1, "made": False, "w": _shown(text, start, end, form, pick)})
            for start, end in (p for c in candidates(text, base_findings(text)) for p in stretches(*c)):
                rows.append({"pick": _hash(doc_id, start, 0), "y": 0, "made": False, "w": window(text, start, end)})
            pick = _hash(doc_id, "chain")
            made, first, last = _placed(text, _chain(text, pick), pick)
            parts = stretches(first, last)
            rows.append({"pick": pick, "y": 0, "made": True, "w": window(made, *parts[pick // 7 % len(parts)])})
        out.append(rows)
    return pd.Series(out, dtype=object)


def train(docs: DataFrame, key="doc_id", text="text", max_findings: int = MAX_FINDINGS) -> Network | None:
    """Learn from at most max_findings findings of either label, and half as many chains; None without both labels.

    The driver receives windows of LENGTH characters, never texts.
    """
    find = F.pandas_udf(_labelled, "array<struct<pick: long, y: int, made: boolean, w: string>>")
    known = docs.where(learnable(F.col(key)) & F.col(text).isNotNull())
    found = known.select(F.explode(find(F.col(key), F.col(text))).alias("f")).select("f.*")
    # One pass: the smallest hashes of both labels, and a window that recurs counts once.
    got = []
    once = found.groupBy("y", "made", "w").agg(F.min("pick").alias("pick")).persist()
    try:
        for y, made, most in ((0, False, max_findings), (0, True, max_findings // 2), (1, False, max_findings)):
            some = once.where((F.col("y") == y) & (F.col("made") == made))
            got += some.orderBy("pick", "w").limit(most).collect()
    finally:
        once.unpersist()
    y = np.array([r["y"] for r in got], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x = encode([r["w"] for r in got])
    aside = np.array([r["pick"] // 3 % 5 == 0 for r in got])
    if any(len(set(part.tolist())) < 2 for part in (y[aside], y[~aside])):
        return Network().fit(x, y).calibrate(x, y)
    return Network().fit(x[~aside], y[~aside]).calibrate(x[aside], y[aside])


def _span(text: str, start: int, end: int, fired) -> tuple[int, int]:
    """The part of a candidate that its firing stretches cover, out to the next joints."""
    first, last = min(a for a, _ in fired), max(b for _, b in fired)
    while first > start and text[first - 1] not in _JOINTS:
        first -= 1
    while last < end and text[last] not in _JOINTS:
        last += 1
    return first, last


def scan(text: str, network: Network | None) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, probability) of all findings; base findings have probability 1."""
    base = base_findings(text)
    more = []
    others = candidates(text, base) if network is not None else []
    if others:
        parts = [(k, *p) for k, (a, b) in enumerate(others) for p in stretches(a, b)]
        # Long texts have many windows; the network takes them in bounded runs.
        p = network.probabilities(encode([window(text, a, b) for _, a, b in parts]))
        fired: dict[int, list] = {}
        for (k, a, b), x in zip(parts, p):
            if x >= network.least:
                fired.setdefault(k, []).append((a, b, float(x)))
        for k, hits in fired.items():
            more.append((*_span(text, *others[k], [h[:2] for h in hits]), "cnn", max(h[2] for h in hits)))
    return in_order([(*f, 1.0) for f in base] + more)


def find(spark, network: Network | None, text: Column) -> Column:
    """array<struct<start, end, kind, probability>> for a text column."""
    shared = spark.sparkContext.broadcast(network)

    @F.pandas_udf("array<struct<start: long, end: long, kind: string, probability: double>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(
                [
                    [{"start": a, "end": b, "kind": k, "probability": p} for a, b, k, p in scan(t or "", shared.value)]
                    for t in part
                ],
                dtype=object,
            )

    return found(text)
