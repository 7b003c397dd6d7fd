"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training texts. Every word has an output with vectors of its own: the most
frequent words and the end of a text one that no other word shares, all others one of CELLS cells, by a hash.
Outputs are predicted in two steps: first a unit, which is a head word or a class of outputs, then the output
within the class. The predicted representation is the sum of two context tables' rows for the two outputs
before; its products with all units, and with all outputs of the class, give exact normalisers. Within a
cell, a word has its add-one share of the cell's training tokens, unknown words as one, so probabilities over
all words, and one unknown word for each cell, sum to one.

Texts are turned into outputs once, and stored as such. Every training text is trained on. Texts are dealt over shards by a hash of id and text, as many as the
count of training tokens says; each shard runs mini-batches over its texts in one order from one start, and
shards' tables are averaged by tokens, in lots of lots. So scores depend on the table's rows alone, not on
files or partitions. Counts of rare words are joined, never sent to every executor.

Defined results: a null or empty text is its end alone; words are case-folded for A-Z; rows of one id are
scored one by one; without any training text all words are unknown and the model is the uniform one; null
ids are training texts.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, documents, keep, mapped, most_frequent, ship, texts

FOLDS, HELD_OUT = 7, 2
#: Units: the end and head words, and classes; outputs of a class; words whose counts all executors hold; the vectors' width.
HEAD, CLASSES, MEMBERS, KNOWN, WIDTH = 64, 96, 96, 100_000, 16
#: Of the outputs in classes, as many are cells that words share.
CELLS = CLASSES * MEMBERS // 2
#: Noise units of a mini-batch, its tokens, the step size, noise outputs within a class, and tokens that are shuffled together.
NOISE, TOKENS, STEP, CLASS_NOISE, CHUNK = 32, 2048, 0.15, 8, 1 << 17
#: A part of the step size: both kinds of output gradients are divided by it.
DAMP = 8
#: Shards: their number grows with the power of the training tokens in units of SHARD_TOKENS.
SHARD_TOKENS, SHARD_POWER = 250_000, 0.75
LOT, BLOCK_ROWS = 64, 256
COUNT_WORDS = 300_000
END = 0


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over all texts; the empty word counts their ends."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for text in texts(b["text"]):
                seen.update(words_of(text))
            seen[b""] += b.num_rows
            if len(seen) > COUNT_WORDS:
                yield batch(schema, [w.decode() for w in seen], list(seen.values()))
                seen = Counter()
        yield batch(schema, [w.decode() for w in seen if seen[w]], [n for n in seen.values() if n])

    return arrow_map(train.select("text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Shape:
    """How outputs are numbered: the end and head words, then those in classes, dealt over the classes in turn."""

    head: int = HEAD
    classes: int = CLASSES
    members: int = MEMBERS
    cells: int = CELLS

    @property
    def outputs(self) -> int:
        return self.head + self.classes * self.members

    @property
    def kind(self) -> np.dtype:
        """Of stored outputs; 16-bit numbers sort fast."""
        return np.dtype("<u2" if self.outputs < 1 << 16 else "<u4")

    @property
    def units(self) -> int:
        return self.head + self.classes

    @property
    def own(self) -> int:
        """Outputs that no two words share."""
        return self.outputs - self.cells

    def unit(self, w: np.ndarray) -> np.ndarray:
        w = w.astype(np.int64)
        return np.where(w < self.head, w, self.head + (w - self.head) % self.classes)

    def member(self, w: np.ndarray) -> np.ndarray:
        """The place of a class's output in the table of members, in which a class's outputs follow each other."""
        return (w - self.head) % self.classes * self.members + (w - self.head) // self.classes

    def cell(self, word: bytes) -> int:
        """The output of a word that has none of its own."""
        return self.own + zlib.crc32(word) % self.cells


@dataclass
class Tables:
    """Two context tables (one row more: before the text), vectors and biases of units and of members."""

    first: np.ndarray
    second: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    member: np.ndarray
    member_bias: np.ndarray

    @staticmethod
    def start(counts: np.ndarray, shape: Shape, seed: int = 7) -> Tables:
        """Random vectors; the biases make it the unigram model."""
        r = np.random.default_rng(seed)
        p = (counts + 1.0) / (counts.sum() + len(counts))
        units, members = unit_shares(p, shape)
        vectors = [r.normal(0, 0.1, (n, WIDTH)).astype(np.float32) for n in (shape.outputs + 1, shape.outputs + 1, shape.units, shape.classes * shape.members)]
        return Tables(vectors[0], vectors[1], vectors[2], np.log(units).astype(np.float32), vectors[3], np.log(members).astype(np.float32))

    def rows(self) -> np.ndarray:
        """All parameters as rows of one matrix."""
        wide = lambda x: np.pad(x[:, None], ((0, 0), (0, WIDTH - 1)))
        return np.concatenate([self.first, self.second, self.out, wide(self.bias), self.member, wide(self.member_bias)])

    @staticmethod
    def of(rows: np.ndarray, shape: Shape) -> Tables:
        sizes = [shape.outputs + 1, shape.outputs + 1, shape.units, shape.units, shape.classes * shape.members]
        first, second, out, bias, member, member_bias = np.split(rows.astype(np.float32), np.cumsum(sizes))
        return Tables(first, second, out, bias[:, 0].copy(), member, member_bias[:, 0].copy())


def unit_shares(p: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Of the outputs' shares, those of units, and of members within their class."""
    members = p[shape.head :].reshape(shape.members, shape.classes).T
    return np.concatenate([p[: shape.head], members.sum(1)]), (members / members.sum(1, keepdims=True)).ravel()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation: a mini-batch shares its noise; steps are scaled per row by past gradients."""

    def __init__(self, tables: Tables, counts: np.ndarray, shape: Shape, seed: int):
        self.t, self.shape, self.random = tables, shape, np.random.default_rng(seed)
        p = (counts + 1.0) / (counts.sum() + len(counts))
        units, members = unit_shares(p, shape)
        self.log_noise, self.cumulative = (np.log(units) + np.log(NOISE)).astype(np.float32), np.cumsum(units)
        self.member_log_noise = (np.log(members) + np.log(CLASS_NOISE)).astype(np.float32)
        self.member_cumulative = np.cumsum(members.reshape(shape.classes, shape.members), 1)
        self.past = {n: np.full(len(getattr(tables, n)), 1e-2, np.float32) for n in ("first", "second", "out", "bias", "member", "member_bias")}

    def _step(self, at: np.ndarray, **gradients: np.ndarray) -> None:
        """Adds up the gradients of equal rows, and moves each table's rows against them."""
        order = np.argsort(at, kind="stable")
        in_order = at[order]
        begin = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]]))
        rows = in_order[begin]
        for name, gradient in gradients.items():
            g = np.add.reduceat(gradient[order], begin, axis=0)
            past = self.past[name][rows]
            past += np.einsum("ij,ij->i", g, g) / g.shape[1] if g.ndim > 1 else g * g
            self.past[name][rows] = past
            scale = np.float32(STEP) / np.sqrt(past)
            g *= scale[:, None] if g.ndim > 1 else scale
            getattr(self.t, name)[rows] -= g

    def _contrast(self, vectors: str, biases: str, log_noise: np.ndarray, h: np.ndarray, w: np.ndarray, noise: np.ndarray) -> np.ndarray:
        """One step for outputs w against shared noise; the gradient of h."""
        v, b = getattr(self.t, vectors), getattr(self.t, biases)
        own, others = v[w], v[noise]
        true = _sigmoid(np.einsum("ij,ij->i", h, own) + (b[w] - log_noise[w])) - np.float32(1)
        false = h @ others.T
        false += b[noise] - log_noise[noise]
        false = _sigmoid(false)
        true /= DAMP
        false /= DAMP
        at = np.concatenate([w, noise.astype(w.dtype)])
        self._step(at, **{vectors: np.concatenate([true[:, None] * h, false.T @ h]), biases: np.concatenate([true, false.sum(0)])})
        own *= true[:, None]
        own += false @ others
        return own

    def batch(self, c2: np.ndarray, c1: np.ndarray, unit: np.ndarray, more: np.ndarray | float = 0.0) -> None:
        """A mini-batch of units after their contexts. more: what is to be added to the contexts' gradients."""
        noise = np.minimum(np.searchsorted(self.cumulative, self.random.random(NOISE)), self.shape.units - 1)
        gh = self._contrast("out", "bias", self.log_noise, self.t.first[c1] + self.t.second[c2], unit, noise) + more
        self._step(c1, first=gh)
        self._step(c2, second=gh)

    def class_batch(self, c2: np.ndarray, c1: np.ndarray, member: np.ndarray, of: int) -> np.ndarray:
        """Members of class ``of`` after their contexts; the contexts' gradients."""
        noise = of * self.shape.members + np.minimum(np.searchsorted(self.member_cumulative[of], self.random.random(CLASS_NOISE)), self.shape.members - 1)
        return self._contrast("member", "member_bias", self.member_log_noise, self.t.first[c1] + self.t.second[c2], member, noise)

    def chunk(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> None:
        """Tokens in random order: members class by class, then units in mini-batches, which move the contexts for both."""
        order = self.random.permutation(len(w))
        w, c1, c2 = w[order], c1[order], c2[order]
        unit, member = self.shape.unit(w).astype(self.shape.kind), np.where(w < self.shape.head, 0, self.shape.member(w.astype(np.int64))).astype(self.shape.kind)
        more = np.zeros((len(w), WIDTH), np.float32)
        by_unit = np.argsort(unit, kind="stable")
        edges = np.searchsorted(unit[by_unit], np.arange(self.shape.head, self.shape.units + 1))
        for of in np.flatnonzero(edges[1:] > edges[:-1]):
            for i in range(edges[of], edges[of + 1], TOKENS):
                at = by_unit[i : min(i + TOKENS, edges[of + 1])]
                more[at] = self.class_batch(c2[at], c1[at], member[at], int(of))
        for i in range(0, len(w), TOKENS):
            self.batch(c2[i : i + TOKENS], c1[i : i + TOKENS], unit[i : i + TOKENS], more[i : i + TOKENS])


class _Numbers(dict):
    """Numbers of known words; of all others, below zero, the output that their cell has."""

    shape: Shape

    def __missing__(self, word: bytes) -> int:
        return ~self.shape.cell(word)


class Vocabulary:
    """Numbers of words: 0 the end, then words with outputs of their own, then further known ones."""

    def __init__(self, frequent: list[bytes], known: list[bytes] = (), shape: Shape = Shape()):  # noqa: B008
        self.shape = shape
        self.number = _Numbers({w: i for i, w in enumerate([b"", *frequent, *known])})
        self.number.shape = shape
        self.output = np.array([END, *range(1, len(frequent) + 1), *(shape.cell(w) for w in known)], np.int64)

    def encode(self, cut: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
        """Of the texts one after the other, each with its end: outputs, each text's tokens, all numbers, all words."""
        flat = [t for c in cut for t in (*c, b"")]
        ids = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        return np.where(ids < 0, ~ids, self.output[np.maximum(ids, 0)]).astype(self.shape.kind), np.array([len(c) + 1 for c in cut]), ids, flat


def contexts(w: np.ndarray, n: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The outputs one and two tokens before; texts of n tokens each follow each other in w."""
    c1, c2 = np.roll(w, 1), np.roll(w, 2)
    start = np.concatenate([[0], np.cumsum(n)])[:-1]
    c1[start] = c2[start] = shape.outputs
    c2[(start + 1)[n > 1]] = shape.outputs
    return c1, c2


def shards_for(tokens: int) -> int:
    return max(1, int(np.ceil((tokens / SHARD_TOKENS) ** SHARD_POWER)))


def train_tables(encoded: DataFrame, counts: np.ndarray, shards: int, shape: Shape) -> Tables:
    """Tables averaged over shards, each of which starts alike and sees all its texts in the order of ids and hashes. encoded: doc_id, tie, outputs."""
    given = encoded.sparkSession.sparkContext.broadcast(counts)
    schema = pa.schema([("block", pa.int32()), ("lot", pa.int64()), ("weight", pa.float64()), ("rows", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = given.value
        at: int | None = None
        trainer, held, tokens, seen = None, [], 0, 0

        def learn() -> None:
            nonlocal held, tokens, seen
            if held:
                w = np.concatenate(held)
                trainer.chunk(w, *contexts(w, np.array([len(x) for x in held]), shape))
                seen += len(w)
            held, tokens = [], 0

        def result() -> pa.RecordBatch:
            rows = trainer.t.rows()
            blocks = [rows[i : i + BLOCK_ROWS].astype("<f4").tobytes() for i in range(0, len(rows), BLOCK_ROWS)]
            return batch(schema, np.arange(len(blocks), dtype=np.int32), np.full(len(blocks), at), np.full(len(blocks), float(seen)), blocks)

        for b in batches:
            for shard, outputs in zip(b["shard"].to_pylist(), b["outputs"].to_pylist(), strict=True):
                if shard != at:
                    learn()
                    if trainer is not None:
                        yield result()
                    at, seen, trainer = shard, 0, Trainer(Tables.start(c, shape), c, shape, shard)
                held.append(np.frombuffer(outputs, shape.kind))
                tokens += len(held[-1])
                if tokens >= CHUNK:
                    learn()
        learn()
        if trainer is not None:
            yield result()

    def mean(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("lot")
        total = sum(w * np.frombuffer(r, "<f4").astype(np.float64) for w, r in zip(p["weight"], p["rows"], strict=True))
        return pd.DataFrame({"block": [int(p["block"].iloc[0])], "lot": [int(p["lot"].iloc[0]) // LOT], "weight": [p["weight"].sum()], "rows": [(total / p["weight"].sum()).astype("<f4").tobytes()]})

    form = "block int, lot long, weight double, rows binary"
    dealt = encoded.select("doc_id", "outputs", F.pmod("tie", F.lit(shards)).alias("shard"), "tie")
    parts = min(shards, max(int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // 8)))
    ordered = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "doc_id", "tie").select("shard", "outputs")
    found, lots = arrow_map(ordered, run, form), shards
    while lots > 1:
        found, lots = found.groupBy("block", F.floor(F.col("lot") / LOT).alias("to")).applyInPandas(mean, form), -(-lots // LOT)
    rows = found.select("block", "rows").collect()
    if not rows:
        return Tables.start(counts, shape)
    return Tables.of(np.frombuffer(b"".join(bytes(r["rows"]) for r in sorted(rows)), "<f4").reshape(-1, WIDTH), shape)


class Scorer:
    """Normalised log probabilities of outputs: of their unit, and of members within their class."""

    def __init__(self, tables: Tables, shape: Shape):
        self.t, self.shape = tables, shape

    @staticmethod
    def _softmax(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probabilities of ``at`` among the outputs of the vectors, exactly normalised."""
        s = h @ vectors.T
        s += bias
        own = s[np.arange(len(s)), at]
        top = s.max()
        if top > 60:  # else sums of exponentials stay within range
            top = s.max(1)
            s -= top[:, None]
            own = own - top
        np.exp(s, out=s)
        return own - np.log(s.sum(1))

    def log_probability(self, w: np.ndarray, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        t, shape = self.t, self.shape
        w = w.astype(np.int64)
        unit = shape.unit(w)
        out = np.empty(len(w), np.float64)
        h = t.first[c1]
        h += t.second[c2]
        for i in range(0, len(w), 512):  # products that stay in the cache
            at = slice(i, i + 512)
            out[at] = self._softmax(h[at], t.out, t.bias, unit[at])
        of = np.argsort(unit.astype(shape.kind), kind="stable")
        edges = np.searchsorted(unit[of], np.arange(shape.head, shape.units + 1))
        for k in np.flatnonzero(edges[1:] > edges[:-1]):
            rows = slice(k * shape.members, (k + 1) * shape.members)
            for i in range(edges[k], edges[k + 1], 1024):
                j = of[i : min(i + 1024, edges[k + 1])]
                out[j] += self._softmax(h[j], t.member[rows], t.member_bias[rows], (w[j] - shape.head) // shape.classes)
        return out


_PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("log_shares", pa.float64()), ("outputs", pa.binary()), ("word", pa.string()), ("times", pa.int64())])
PART = "row long, doc_id long, tie long, n_tokens long, n_known long, log_counts double, log_shares double, outputs binary, word string, times long"


#: What a worker keeps between its tasks, of the last call only.
_LAST: dict[str, tuple] = {}


def encoded(docs: DataFrame, frequent: list[bytes], known: list[tuple[bytes, int]], cell_totals: np.ndarray, shape: Shape) -> DataFrame:
    """A row for each text, with its outputs and what all executors know of its words, and one for each of its rare words.

    row is a random number that ties them together: the table has to be stored before it is used.
    """
    given, key = docs.sparkSession.sparkContext.broadcast((frequent, known, cell_totals)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LAST:
            _LAST.clear()
            frequent, known, cell_totals = given.value
            counts = dict(known)
            v = Vocabulary(frequent, [w for w, _ in known if w][len(frequent) :], shape)
            logs = np.array([np.log10(counts.get(w, 0) + 1.0) for w in v.number])
            seen = np.array([w in counts for w in v.number], np.int64)
            _LAST[key] = v, logs, seen, np.concatenate([np.zeros(shape.own), -np.log10(cell_totals + 1.0)])
        v, logs, seen, share = _LAST[key]
        random = np.random.default_rng()
        for b in batches:
            many = [words_of(t) for t in texts(b["text"])]
            if not many:
                continue
            w, n, ids, flat = v.encode(many)
            begin = np.concatenate([[0], np.cumsum(n)])
            total = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: B023, E731
            row = random.integers(-(1 << 63), 1 << 63, len(many), dtype=np.int64)
            rare = ids < 0
            log = np.where(rare, 0.0, logs[np.maximum(ids, 0)])  # of counts known here; those of rare words are joined
            shares = share[w] + np.where(w >= shape.own, log, 0.0)
            yield batch(_PART, row, b["doc_id"], b["tie"], n, total(np.where(rare, 0, seen[np.maximum(ids, 0)])), total(log), total(shares), [w[i:j].tobytes() for i, j in zip(begin, begin[1:], strict=False)], pa.nulls(len(many), pa.string()), pa.nulls(len(many), pa.int64()))
            at = np.flatnonzero(rare)
            if len(at):
                new = Counter(zip(np.searchsorted(begin[:-1], at, "right").tolist(), [flat[i] for i in at], strict=True))
                of, words = zip(*new, strict=True)
                yield batch(_PART, row[np.array(of) - 1], *(pa.nulls(len(words), f.type) for f in list(_PART)[1:8]), [t.decode() for t in words], list(new.values()))

    return arrow_map(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tie"), "text"), run, PART)


def modelled(parts: DataFrame, tables: Tables, shape: Shape) -> DataFrame:
    """The rows of texts with log_model, the outputs' log10 probability. Executors get the model as a file and map it."""
    packed, key = io.BytesIO(), uuid.uuid4().hex
    np.save(packed, tables.rows())
    name = ship(parts.sparkSession, packed.getvalue(), "lm-model")
    kept = ("row", "doc_id", "n_tokens", "n_known", "log_counts", "log_shares")
    schema = pa.schema([*(_PART.field(n) for n in kept), pa.field("log_model", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LAST:
            _LAST.clear()
            _LAST[key] = (Scorer(Tables.of(np.load(io.BytesIO(mapped(name))), shape), shape),)
        (scorer,) = _LAST[key]
        for b in batches:
            if b.num_rows:
                w, n = np.frombuffer(b"".join(b["outputs"].to_pylist()), shape.kind), b["n_tokens"].to_numpy()
                log = scorer.log_probability(w, *contexts(w, n, shape)) / np.log(10)
                yield batch(schema, *(b[c] for c in kept), np.add.reduceat(log, np.concatenate([[0], np.cumsum(n)])[:-1]))

    return arrow_map(parts.filter("word is null").select(*kept, "outputs"), run, "row long, doc_id long, n_tokens long, n_known long, log_counts double, log_shares double, log_model double")


def _in_cells(counts: DataFrame, shape: Shape) -> np.ndarray:
    """Training tokens and distinct words of all words that hash to each cell, a row for each."""
    cell = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(shape.cells)).cast("int").alias("cell")
    out = np.zeros((shape.cells, 2), np.int64)
    for r in counts.filter("word <> ''").select(cell, "n").groupBy("cell").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        out[r["cell"]] = r["n"], r["words"]
    return out


@dataclass
class Model:
    """A fitted model and the encoded texts. in_cells: training tokens and distinct words of each cell."""

    shape: Shape
    tables: Tables
    frequent: list[bytes]
    in_cells: np.ndarray
    total: int
    distinct: int
    counts: DataFrame
    parts: DataFrame


def fit(docs: DataFrame, shape: Shape = Shape(), known_words: int = KNOWN) -> Model:  # noqa: B008
    """Counts words, encodes all texts and trains on those that aren't held out."""
    d = documents(docs)
    counts = keep(count_words(d.filter(~held_out())), "lm-counts")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    total = total or 0
    ends = counts.filter("word = ''").agg(F.sum("n")).first()[0] or 0
    known = [(w.encode(), n) for w, n in most_frequent(counts, known_words) if w]
    if ends:  # however many words are more frequent: it has output 0 and is never joined
        known.append((b"", ends))
    number = dict(known)
    listed = [w for w, _ in known if w]
    frequent = listed[: shape.own - 1]
    in_cells = _in_cells(counts, shape)
    for w in frequent:
        in_cells[shape.cell(w) - shape.own] -= number[w], 1
    outputs = np.zeros(shape.outputs)
    outputs[0] = ends
    outputs[1 : len(frequent) + 1] = [number[w] for w in frequent]
    outputs[shape.own :] = in_cells[:, 0]
    parts = keep(encoded(d, frequent, known, in_cells.sum(1).astype(float), shape), "lm-parts")
    tables = train_tables(parts.filter("word is null").filter(~held_out()), outputs, shards_for(total), shape)
    return Model(shape, tables, frequent, in_cells, total, distinct, counts, parts)


def scores(m: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) of every text."""
    rare = m.parts.filter("word is not null").select("word", "row", "times").join(m.counts, "word")
    tail = rare.select("row", (F.log10(F.col("n") + 1.0) * F.col("times")).alias("log"), "times").groupBy("row").agg(F.sum("log").alias("tail"), F.sum("times").alias("tail_known"))
    every = modelled(m.parts, m.tables, m.shape).join(tail, "row", "left").fillna({"tail": 0.0, "tail_known": 0})
    base = F.col("log_counts") + F.col("tail") - F.col("n_tokens") * float(np.log10(m.total + m.distinct + 1))
    return every.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + F.col("tail_known")).cast("long").alias("n_known"), F.lit(m.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_model") + F.col("log_shares") + F.col("tail")).alias("score"))


def score_documents(docs: DataFrame, shape: Shape = Shape(), known_words: int = KNOWN) -> DataFrame:  # noqa: B008
    return scores(fit(docs, shape, known_words))
