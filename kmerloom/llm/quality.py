"""Quality rules: fixed rules on document statistics, then gradient-boosted trees on the same statistics.

The trees are fitted in numpy on a bounded, deterministic sample of labelled documents and flattened into
node arrays, so that a batch of documents is scored level by level without a loop over rows. Chosen
features are monotonic: more symbols, repeated lines or repeated words never raise a score.

Defined results: null and empty texts have no words and fail the base rules; without any usable label, or
with labels of one class only, the base rules decide alone; null labels are left out; a document with
several labels counts once for each.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, documents, texts

#: Labelled rows that the trees are fitted on: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS = 60, 3, 0.2, 64, 20
#: A document is kept from this probability of good quality on.
KEEP = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "punctuation_rate", "distinct_rate", "words_per_line", "long_word_rate", "bang_rate")
#: -1: more of it never raises the score.
MONOTONIC = {"symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "bang_rate": -1}
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_ALL = bytes(range(256))
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def _others(of: bytes) -> bytes:
    return bytes(b for b in _ALL if b not in of)


_KEEP = {k: _others(v) for k, v in {"symbols": SYMBOLS, "spaces": SPACES, "upper": _UPPER, "digits": _DIGITS, "bang": b"!?", "marks": b".,;:!?"}.items()}


def _many(raw: bytes, kind: str) -> int:
    return len(raw.translate(None, _KEEP[kind]))


def repeat_words(ids: np.ndarray) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(ids) < 4:
        return 0
    top = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * top + ids[1:], return_inverse=True)[1]
    code = pairs[:-1] * top + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(code), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : len(ids) - 2 + k] |= again
    return int(hit.sum())


def statistics(text: str) -> tuple[tuple[int, ...], list[float]]:
    """STATS and FEATURES of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, _many(raw, "symbols"), 0, 0), [0.0] * len(FEATURES)
    number = dict(zip(dict.fromkeys(words), count()))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    seen: set[str] = set()
    dup = full = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACES):
            full += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - _many(raw, "spaces")
    symbols, repeated = _many(raw, "symbols"), repeat_words(ids)
    long = sum(len(w) > 24 for w in number)
    features = [np.log1p(n), chars / n, symbols / chars, dup / full, repeated / n, _many(raw, "upper") / chars, _many(raw, "digits") / chars, _many(raw, "marks") / n, len(number) / n, n / full, long / len(number), _many(raw, "bang") / n]
    return (n, chars, symbols, dup, repeated), features


def base_fails(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words


@dataclass
class Trees:
    """Node arrays of all trees; a leaf's children are itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotonic: dict[str, int] | None = None, names: tuple[str, ...] = FEATURES) -> Trees | None:
    """Newton boosting of the logistic loss over binned features; None unless both classes are there."""
    if len(y) == 0 or y.min() == y.max():
        return None
    signs = np.array([(MONOTONIC if monotonic is None else monotonic).get(n, 0) for n in names])
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    start = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), start)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, depth: int) -> int:
        i = len(feature)
        own = float(np.clip(-g[rows].sum() / (h[rows].sum() + 1.0), low, high))
        for a, v in ((feature, 0), (threshold, np.inf), (left, i), (right, i), (value, RATE * own)):
            a.append(v)
        best = (1e-6, -1, -1, 0.0, 0.0)
        if depth < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            G, H = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = bins[rows, j]
                gl, hl, nl = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], None))
                vl, vr = np.clip(-gl / (hl + 1), low, high), np.clip(-(G - gl) / (H - hl + 1), low, high)
                score = lambda gs, hs, v: -(gs * v + 0.5 * (hs + 1) * v * v)
                gain = score(gl, hl, vl) + score(G - gl, H - hl, vr) - score(G, H, own)
                gain[(nl < LEAST_ROWS) | (len(rows) - nl < LEAST_ROWS) | (signs[j] * (vr - vl) < 0)] = -1
                if gain[k := int(gain.argmax())] > best[0]:
                    best = (float(gain[k]), j, k, float(vl[k]), float(vr[k]))
        if best[1] >= 0:
            _, j, k, vl, vr = best
            go = bins[rows, j] <= k
            middle = (vl + vr) / 2
            bounds = ((low, min(high, middle)), (max(low, middle), high)) if signs[j] > 0 else ((max(low, middle), high), (low, min(high, middle))) if signs[j] < 0 else ((low, high),) * 2
            feature[i], threshold[i] = j, cuts[j][k]
            left[i] = node(rows[go], g, h, *bounds[0], depth + 1)
            right[i] = node(rows[~go], g, h, *bounds[1], depth + 1)
        return i

    everyone = np.arange(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(node(everyone, p - y, p * (1 - p), -np.inf, np.inf, 0))
        one = Trees(*(np.array(a) for a in (feature, threshold, left, right, value)), np.array(roots[-1:]), 0.0)
        margin += one.margin(x)
    return Trees(*(np.array(a) for a in (feature, threshold, left, right, value, roots)), start)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees | None:
    """Trees on at most ``rows`` labelled documents, those whose ids hash smallest; quality 1 is good."""
    sampled = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("double").alias("quality")).filter("label_id is not null and quality is not null").orderBy(F.xxhash64("label_id"), "label_id", "quality").limit(rows)
    schema = pa.schema([("quality", pa.float64()), ("features", pa.list_(pa.float64())), ("doc_id", pa.int64())])

    def run(batches):
        for b in batches:
            yield batch(schema, b["quality"], [statistics(t)[1] for t in texts(b["text"])], b["doc_id"])

    d = documents(docs)
    found = arrow_map(d.join(F.broadcast(sampled), d.doc_id == F.col("label_id")).select("quality", "text", "doc_id"), run, "quality double, features array<double>, doc_id long").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(rows).toArrow()
    order = np.lexsort((found["quality"].to_numpy(), found["doc_id"].to_numpy()))
    x = np.array(found["features"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, (found["quality"].to_numpy()[order] > 0).astype(float))


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
_OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in STATS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())])


def judge(docs: DataFrame, trees: Trees | None, keep: float = KEEP) -> DataFrame:
    """Statistics, base rules and verdict of every document; nothing is shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        for b in batches:
            found = [statistics(t) for t in texts(b["text"])]
            x = np.array([f for _, f in found], float).reshape(-1, len(FEATURES))
            p = model.value.probability(x) if model.value is not None else np.ones(len(found))
            failed = np.array([base_fails(s[0], s[4]) for s, _ in found], bool)
            yield batch(_OUT, b["doc_id"], *zip(*(s for s, _ in found), strict=True), failed, ~failed & (p >= keep), p) if found else batch(_OUT, *[[]] * len(_OUT))

    return arrow_map(documents(docs), run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    return judge(docs, train(docs, labels, rows), keep)


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, keep: float = KEEP) -> DataFrame:
    """The rows, whole, of documents that pass the base rules and the trees."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, rows))

    def run(batches):
        for b in batches:
            found = [statistics(t) for t in texts(b["text"])]
            if found:
                x = np.array([f for _, f in found], float)
                p = model.value.probability(x) if model.value is not None else np.ones(len(found))
                yield b.filter(pa.array([bool(q >= keep) and not base_fails(s[0], s[4]) for (s, _), q in zip(found, p, strict=True)]))

    return arrow_map(docs, run, docs.schema)
