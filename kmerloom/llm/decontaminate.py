"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items (questions and answers) are lower-cased (A-Z) and cut into words; every window of ten words, or
the whole item where it has fewer, becomes a pattern over word numbers. The automaton is built once, level
by level, as sorted arrays of some 17 bytes a state; each executor gets one file of it, which its workers
map. Documents are normalised the same way and scanned once, a batch's texts side by side: a state depends
on the last ten words only, so long texts go in stretches that overlap by nine. Hits are mapped back to
word numbers and to character offsets of the original text.

Defined results: a null or empty text has no words and isn't contaminated; a null or empty item has no
window; repeated items keep their own ids and both count; repeated documents each get their row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, documents, mapped, ship, texts

WINDOW = 10
#: Bytes of item texts in one automaton of at most some 500 MB; a larger benchmark is scanned for in parts, one after the other.
PART_BYTES = 16 << 20
#: Words that a stretch of text has to itself while texts are scanned side by side.
STRETCH = 512

_WORD_BYTES = frozenset([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_NORMAL = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _WORD_BYTES else 0x20 for b in range(256))
_WORDS = re.compile(rb"[^ ]+")

SCHEMA = "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"
PART_SCHEMA = "doc_id long, text string, ranges array<array<long>>, item_ids array<string>"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_PART = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("ranges", pa.list_(pa.list_(pa.int64()))), ("item_ids", pa.list_(pa.string()))])


def words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


class Automaton:
    """Goto, failure and output arrays over word numbers; 0 is a word of no item, state 0 the root.

    State k + 1 is reached by the k-th key, which is its parent's number times ``width`` plus a word: keys ascend,
    since states are numbered level by level. ``out`` is the longest pattern that ends in a state, as a state;
    the items of the patterns in ``ends`` are items[first[i] : first[i + 1]].
    """

    ARRAYS = (("keys", np.int64), ("fail", np.int32), ("out", np.int32), ("depth", np.int8), ("ends", np.int32), ("first", np.int64), ("items", np.int32), ("names", np.uint8), ("vocabulary", np.uint8))

    def __init__(self, data, size: int = WINDOW):
        self.size, at = size, 0
        lengths = np.frombuffer(data, np.int64, len(self.ARRAYS))
        at = 8 * len(lengths)
        for (name, kind), n in zip(self.ARRAYS, lengths, strict=True):
            setattr(self, name, np.frombuffer(data, kind, int(n), at))
            at += -(-int(n) * np.dtype(kind).itemsize // 8) * 8
        words = self.vocabulary.tobytes().split(b" ") if len(self.vocabulary) else []
        self.number = dict(zip(words, range(1, len(words) + 1), strict=True))
        self.width = len(words) + 1
        self.ids = self.names.tobytes().decode().split("\0")

    @classmethod
    def pack(cls, **arrays: np.ndarray) -> bytes:
        parts = [np.ascontiguousarray(arrays[name], kind) for name, kind in cls.ARRAYS]
        return np.array([len(x) for x in parts], np.int64).tobytes() + b"".join(x.tobytes().ljust(-(-x.nbytes // 8) * 8, b"\0") for x in parts)

    def go(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states of many texts."""
        return _go(self.keys, self.fail, self.width, state, word)

    def states(self, words: np.ndarray) -> np.ndarray:
        """The state after each word; 0 among the words parts texts."""
        lanes = -(-len(words) // STRETCH)
        before = self.size - 1
        padded = np.zeros(before + lanes * STRETCH, np.int64)
        padded[before : before + len(words)] = words
        by_step = np.lib.stride_tricks.sliding_window_view(padded, before + STRETCH)[::STRETCH].T
        out = np.zeros((before + STRETCH, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for k, w in enumerate(by_step):
            state = out[k] = self.go(state, w)
        return out[before:].T.ravel()[: len(words)]

    def scan(self, many: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
        """For each text, as words: maximal ranges [first, last] of hit words, in order, and the items hit."""
        n = np.array([len(x) + 1 for x in many], np.int64)
        words = np.fromiter((self.number.get(w, 0) for x in many for w in (*x, b"")), np.int64, int(n.sum()))
        start = np.concatenate([[0], np.cumsum(n)])
        edges, pairs = np.zeros(len(words) + 1, np.int64), []
        at = np.flatnonzero(ended := self.out[self.states(words)])
        pattern = ended[at]
        while len(at):
            np.add.at(edges, at - self.depth[pattern] + 1, 1)
            np.add.at(edges, at + 1, -1)
            text = np.searchsorted(start, at, "right") - 1
            pairs.append(np.unique(text * (len(self.keys) + 1) + pattern))
            pattern = self.out[self.fail[pattern]]
            at, pattern = at[pattern > 0], pattern[pattern > 0]
        found: list[tuple[list[list[int]], set[str]]] = [([], set()) for _ in many]
        if not pairs:
            return found
        hit = np.cumsum(edges[:-1]) > 0
        turn = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        for a, z in zip(turn[::2], turn[1::2], strict=True):
            text = int(np.searchsorted(start, a, "right")) - 1
            found[text][0].append([int(a - start[text]), int(z - 1 - start[text])])
        for pair in np.unique(np.concatenate(pairs)):
            text, pattern = divmod(int(pair), len(self.keys) + 1)
            i = np.searchsorted(self.ends, pattern)
            found[text][1].update(self.ids[j] for j in self.items[self.first[i] : self.first[i + 1]])
        return found


def _go(keys: np.ndarray, fail: np.ndarray, width: int, state: np.ndarray, word: np.ndarray) -> np.ndarray:
    out = np.zeros(len(state), np.int32)
    if not len(keys):
        return out
    live = np.flatnonzero(word)
    at = state[live].astype(np.int64)
    while len(live):
        key = at * width + word[live]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        there = keys[k] == key
        out[live[there]] = k[there] + 1
        on = ~there & (at > 0)
        live, at = live[on], fail[at[on]].astype(np.int64)
    return out


def build(items: list[tuple[str, str]], size: int = WINDOW) -> bytes | None:
    """The automaton of all windows of (item_id, text), as one file. None if there is no window."""
    ids = sorted({i for i, _ in items})
    number = {i: k for k, i in enumerate(ids)}
    cut = [(number[i], w) for i, t in items if (w := words(t))]
    if not cut:
        return None
    vocabulary = sorted({x for _, w in cut for x in w})
    of_word = dict(zip(vocabulary, range(1, len(vocabulary) + 1), strict=True))
    width = len(vocabulary) + 1
    text = np.fromiter((of_word[x] for _, w in cut for x in w), np.int64)
    lengths = np.array([len(w) for _, w in cut])
    windows = np.maximum(lengths - size + 1, 1)
    begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    starts = np.repeat(begin - np.concatenate([[0], np.cumsum(windows)])[:-1], windows) + np.arange(windows.sum())
    long = np.repeat(np.minimum(lengths, size), windows)
    item = np.repeat([i for i, _ in cut], windows)
    state = np.zeros(len(starts), np.int64)
    keys, depth, fail = np.zeros(0, np.int64), [np.zeros(1, np.int8)], np.zeros(1, np.int32)
    for d in range(int(long.max())):
        on = np.flatnonzero(long > d)
        new, which = np.unique(state[on] * width + text[starts[on] + d], return_inverse=True)
        state[on] = len(keys) + 1 + which.reshape(-1)
        parent, word = new // width, new % width
        up = fail[parent] if d else None  # keys hold the levels above only, which failures lead to
        fail = np.concatenate([fail, np.zeros(len(new), np.int32) if up is None else _go(keys, fail, width, up, word)])
        keys = np.concatenate([keys, new])
        depth.append(np.full(len(new), d + 1, np.int8))
    pairs = np.unique(np.stack([state, item], 1), axis=0)
    ends, first = np.unique(pairs[:, 0], return_index=True)
    depth = np.concatenate(depth)
    out = np.zeros(len(keys) + 1, np.int32)
    out[ends] = ends
    for d in range(1, int(depth.max()) + 1):  # shorter patterns first
        at = np.flatnonzero((depth == d) & (out == 0))
        out[at] = out[fail[at]]
    names = np.frombuffer("\0".join(ids).encode(), np.uint8)
    return Automaton.pack(keys=keys, fail=fail, out=out, depth=depth, ends=ends, first=np.append(first, len(pairs)), items=pairs[:, 1], names=names, vocabulary=np.frombuffer(b" ".join(vocabulary), np.uint8))


def _join(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


#: The automata that a worker used last, by their files: mapped, so that only their words' numbers are its own.
_LAST: dict[str, Automaton] = {}
LAST = 16


def _automaton(name: str | None, size: int) -> Automaton | None:
    if name is not None and name not in _LAST:
        if len(_LAST) >= LAST:
            del _LAST[next(iter(_LAST))]
        _LAST[name] = Automaton(mapped(name), size)
    return _LAST[name] if name is not None else None


def _found(name: str | None, size: int, cut: list[list[bytes]]) -> list[tuple[list[list[int]], set[str]]]:
    automaton = _automaton(name, size)
    return automaton.scan(cut) if automaton and cut else [([], set()) for _ in cut]


def _map(name: str | None, size: int, last: bool):
    """Scans for one part of the items; earlier parts' ranges come in with the rows, the last part closes them."""

    def run(batches):
        for b in batches:
            before = "ranges" in b.schema.names
            old = zip(b["ranges"].to_pylist(), b["item_ids"].to_pylist(), strict=True) if before else ((None, None),) * b.num_rows
            many = texts(b["text"])
            cut = [words(t) for t in many]
            hits, items, spans = [], [], []
            for text, (ranges, ids), (ranges0, ids0) in zip(many, _found(name, size, cut), old, strict=True):
                if ranges0:
                    ranges, ids = _join(ranges0 + ranges), ids | set(ids0)
                hits.append(ranges)
                items.append(sorted(ids))
                spans.append(_characters(text, ranges) if last else None)
            if last:
                yield batch(_OUT, b["doc_id"], [len(c) for c in cut], [sum(z - a + 1 for a, z in r) for r in hits], items, spans)
            else:
                yield batch(_PART, b["doc_id"], b["text"], hits, items)

    return run


def _characters(text: str, ranges: list[list[int]]) -> list[dict[str, int]]:
    """Offsets in the original text of runs of words."""
    if not ranges:
        return []
    raw = text.encode()
    at = [m.span() for m in _WORDS.finditer(raw.translate(_NORMAL))]
    spans, seen, chars = [], 0, 0
    for first, last in ranges:
        ends = []
        for byte in (at[first][0], at[last][1]):
            chars += len(raw[seen:byte].decode())
            seen = byte
            ends.append(chars)
        spans.append({"start": ends[0], "end": ends[1]})
    return spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Per document: n_words, n_hit, item_ids, spans (character offsets of the hit runs of words).

    Items make one automaton up to about ``part_bytes`` of text (any usual benchmark), and a document is
    scanned once; else there is one for each part, built one after the other. Nothing is shuffled.
    """
    out = documents(docs)
    every = _parts(benchmark, part_bytes, size)
    for i, name in enumerate(every):
        last = i == len(every) - 1
        out = arrow_map(out, _map(name, size, last), SCHEMA if last else PART_SCHEMA)
    return out


def _parts(benchmark: DataFrame, part_bytes: int, size: int) -> list[str | None]:
    """Files of automata, as many as keep each near ``part_bytes`` of text; one at least. The driver holds one part at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // part_bytes) or 1
    out = []
    for part in range(parts):
        chosen = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        built = build([tuple(r) for r in chosen.collect()], size)
        out.append(ship(benchmark.sparkSession, built, "automaton") if built else None)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows, whole, of documents that hold no window of any item."""
    for name in _parts(benchmark, part_bytes, size):

        def run(batches, name=name):
            for b in batches:
                if b.num_rows:
                    yield b.filter(pa.array([not ranges for ranges, _ in _found(name, size, [words(t) for t in texts(b["text"])])]))

        docs = arrow_map(docs, run, docs.schema)
    return docs
