"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent pre-tokens, counted over all texts, and their ids are compiled into an automaton that shares
prefixes and suffixes; the sum of the outputs along a word's path is its number, which indexes its ids.
Executors get it as one memory-mapped file and walk all new words of a batch at once. Words outside it
are merged exactly, many words at a time. Ids and decoded texts are those of the tokenizers library.

Defined results: null and empty texts have no tokens; special tokens in a text get their own id;
bytes that aren't UTF-8 after decoding become U+FFFD; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import uuid
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, discard, documents, keep, mapped, most_frequent, ship, texts

#: Words in the lexicon: bounds the broadcast to a few MB.
LEXICON_WORDS = 60_000
#: Words that a worker remembers, and the words that one task counts, before it starts again or hands over.
MEMO_WORDS, COUNT_WORDS = 400_000, 300_000
#: Words of up to so many bytes are merged side by side in one matrix.
WIDE = 48

SCHEMA = "doc_id long, ids array<int>"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """What a byte-level BPE tokenizer file says: ids, merges and special tokens."""

    def __init__(self, text: str):
        x = json.loads(text)
        vocab, letters = x["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in x["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in x["model"]["merges"]]
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks, self.merged = pairs[order], order.astype(np.int64), np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    NONE = np.int64(1 << 40)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE if there is none."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], self.NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Exact merges, lowest rank first and leftmost among equals; ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) <= WIDE:
                groups.setdefault(-(-len(w) // 8) * 8, []).append(i)
            else:
                out[i] = self._long(w)
        for width, of in groups.items():
            if width:
                for i, ids in zip(of, self._side_by_side([words[i] for i in of], width), strict=True):
                    out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes], width: int) -> list[bytes]:
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < n[:, None], self.first[raw], -1)
        ids = np.concatenate([ids, np.full((len(words), 1), -1)], 1)
        ranks = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width)
        done: list[bytes] = [b""] * len(words)
        at = np.arange(len(words))
        columns = np.arange(width)
        while len(at):
            best = ranks.argmin(1)
            r = ranks[np.arange(len(at)), best]
            stop = r == self.NONE
            if stop.any():
                for k in np.flatnonzero(stop):
                    done[at[k]] = ids[k, : n[k]].astype("<u4").tobytes()
                go = ~stop
                at, ids, ranks, n, best, r = at[go], ids[go], ranks[go], n[go], best[go], r[go]
                if not len(at):
                    break
            rows = np.arange(len(at))
            take = columns[None, :] + (columns[None, :] > best[:, None])  # what stands right of the merged pair moves one to the left
            ids = np.concatenate([np.take_along_axis(ids, take, 1), np.full((len(at), 1), -1)], 1)
            ids[rows, best] = self.merged[r]
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(at), 1), self.NONE)], 1), take, 1)
            n = n - 1
            ranks[rows, best] = self.rank(ids[rows, best], ids[rows, best + 1])
            left = np.maximum(best - 1, 0)
            ranks[rows, left] = np.where(best > 0, self.rank(ids[rows, left], ids[rows, best]), ranks[rows, left])
        return done

    def _long(self, word: bytes) -> bytes:
        """A heap of pairs over a linked list: long words take time in proportion to their length, nearly."""
        ids = self.first[np.frombuffer(word, np.uint8)].tolist()
        last = len(ids)
        before, after = list(range(-1, last - 1)), list(range(1, last + 1))
        known = self.rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(known) if r != self.NONE]
        heapify(heap)
        cache: dict[tuple[int, int], int] = {}

        def push(i: int) -> None:
            if i >= 0 and (j := after[i]) < last:
                pair = (ids[i], ids[j])
                if pair not in cache:
                    cache[pair] = int(self.rank(np.array([pair[0]]), np.array([pair[1]]))[0])
                if cache[pair] != self.NONE:
                    heappush(heap, (cache[pair], i, *pair))

        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j >= last or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < last:
                before[after[i]] = i
            push(before[i])
            push(i)
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def compile_lexicon(entries: dict[bytes, bytes]) -> bytes:
    """The minimal acyclic transducer of words and their ids, as one file.

    States are arcs' sources; arcs are sorted by (state, byte) with target and output. The outputs on a
    word's path add up to its place in the sorted words, whose ids follow each other in the file.
    """
    words = sorted(w for w in entries if w)
    states: list[list] = [[False, {}]]  # final, byte -> state
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # source, byte, target: not yet minimal

    def minimize(depth: int) -> None:
        while len(path) > depth:
            source, byte, target = path.pop()
            key = (states[target][0], tuple(states[target][1].items()))
            states[source][1][byte] = register.setdefault(key, target)

    last = b""
    for w in words:
        common = next((i for i, (x, y) in enumerate(zip(w, last, strict=False)) if x != y), min(len(w), len(last)))
        minimize(common)
        at = path[-1][2] if path else 0
        for byte in w[common:]:
            states.append([False, {}])
            states[at][1][byte] = len(states) - 1
            path.append((at, byte, len(states) - 1))
            at = len(states) - 1
        states[at][0] = True
        last = w
    minimize(0)
    number: dict[int, int] = {}
    count: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # words accepted from each state, children first
        s, ready = stack.pop()
        if s in count and not ready:
            continue
        if ready:
            count[s] = states[s][0] + sum(count[t] for t in states[s][1].values())
        else:
            number.setdefault(s, len(number))
            stack.append((s, True))
            stack += [(t, False) for t in states[s][1].values() if t not in count]
    keys, targets, outputs = [], [], []
    for s, i in number.items():
        out = int(states[s][0])
        for byte, t in states[s][1].items():
            keys.append(i * 256 + byte)
            targets.append(number[t])
            outputs.append(out)
            out += count[t]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    final = np.zeros(len(number), np.uint32)
    for s, i in number.items():
        final[i] = states[s][0]
    parts = [np.array(x, np.uint32)[order] if len(x) else np.zeros(0, np.uint32) for x in (keys, targets, outputs)] + [final]
    lengths = np.array([len(entries[w]) // 4 for w in words], np.int64)
    parts += [np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint32), np.frombuffer(b"".join(entries[w] for w in words), "<u4").astype(np.uint32)]
    return np.array([len(p) for p in parts], np.uint32).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon; its arrays lie in the file's map, or in the bytes given."""

    def __init__(self, data: mmap.mmap | bytes):
        sizes = np.frombuffer(data, np.uint32, 6)
        at, parts = 24, []
        for n in sizes:
            parts.append(np.frombuffer(data, np.uint32, int(n), at))
            at += 4 * int(n)
        self.keys, self.targets, self.outputs, self.final, self.starts, self.ids = parts

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None if it isn't in the lexicon. All words take their steps together."""
        out: list[bytes | None] = [None] * len(words)
        if not len(self.keys):
            return out
        n = np.array([len(w) for w in words])
        order = np.argsort(-n, kind="stable")
        raw, start = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(n)])[:-1]
        live = order[n[order] > 0]
        state = np.zeros(len(words), np.int64)
        number = np.zeros(len(words), np.int64)
        step = 0
        while len(live):
            key = (state[live] * 256 + raw[start[live] + step]).astype(np.uint32)  # as keys are, or all of them would be copied
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            live, at = live[there], at[there]
            state[live] = self.targets[at]
            number[live] += self.outputs[at]
            step += 1
            ended = n[live] == step
            for i in live[ended & (self.final[state[live]] == 1)]:
                k = number[i]
                out[i] = self.ids[self.starts[k] : self.starts[k + 1]].astype("<u4").tobytes()
            live = live[~ended]
        return out


class Encoder:
    """Encodes and decodes in one worker. lexicon: a compiled one, or None to merge every word."""

    def __init__(self, vocabulary: Vocabulary, lexicon: mmap.mmap | bytes | None = None):
        self.vocabulary, self.lexicon, self.memo = vocabulary, Lexicon(lexicon) if lexicon else None, {}

    def pretokens(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens."""
        v = self.vocabulary
        if v.split is None or not v.split.search(text):
            return PRETOKEN.findall(text)
        out: list[str | int] = []
        at = 0
        for m in v.split.finditer(text):
            out += PRETOKEN.findall(text[at : m.start()])
            out.append(v.special[m[0]])
            at = m.end()
        return out + PRETOKEN.findall(text[at:])

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.pretokens(t) for t in many]
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        memo = self.memo
        new = list({w for c in cut for w in c if w not in memo})
        for w in [w for w in new if isinstance(w, int)]:
            memo[w] = np.array([w], "<u4").tobytes()
        new = [w for w in new if isinstance(w, str)]
        raw = [w.encode() for w in new]
        found = self.lexicon.find(raw) if self.lexicon and raw else [None] * len(raw)
        unseen = [i for i, x in enumerate(found) if x is None]
        for i, ids in zip(unseen, self.vocabulary.merge([raw[i] for i in unseen]), strict=True):
            found[i] = ids
        memo.update(zip(new, found, strict=True))
        return [b"".join([memo[w] for w in c]) for c in cut]

    def decode(self, ids: bytes) -> str:
        of = self.vocabulary.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


#: What a worker keeps between its tasks: the encoder of the last call.
_LAST: dict[str, Encoder] = {}


def kept_encoder(key: str, vocabulary: str, lexicon: str | None = None) -> Encoder:
    """The worker's encoder for a call of an operator, key being the call's own. lexicon: the name of a shipped file."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Encoder(Vocabulary(vocabulary), mapped(lexicon) if lexicon else None)
    return _LAST[key]


def _counts(vocabulary):
    key = uuid.uuid4().hex
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(seen: Counter) -> pa.RecordBatch:
        of = [w for w in seen if isinstance(w, str)]
        return batch(schema, of, [seen[w] for w in of])

    def run(batches):
        encoder = kept_encoder(key, vocabulary.value)
        seen: Counter = Counter()
        for b in batches:
            for text in texts(b["text"]):
                seen.update(encoder.pretokens(text))
            if len(seen) > COUNT_WORDS:
                yield rows(seen)
                seen = Counter()
        yield rows(seen)

    return run


def lexicon(docs: DataFrame, vocabulary_json: str, words: int = LEXICON_WORDS) -> bytes:
    """The transducer of the most frequent words of all texts."""
    spark = docs.sparkSession
    counted = arrow_map(docs.select(F.col("text").cast("string").alias("text")), _counts(spark.sparkContext.broadcast(vocabulary_json)), "word string, n long")
    counts = keep(counted.groupBy("word").agg(F.sum("n").alias("n")), "bpe-counts")
    frequent = [w.encode() for w, _ in most_frequent(counts, words)]
    discard(counts)
    return compile_lexicon(dict(zip(frequent, Vocabulary(vocabulary_json).merge(frequent), strict=True)))


def _load(docs: DataFrame, path: str, compiled: bytes | None, words: int):
    with open(path, encoding="utf-8") as f:
        vocabulary_json = f.read()
    spark = docs.sparkSession
    return spark.sparkContext.broadcast(vocabulary_json), ship(spark, compiled if compiled is not None else lexicon(docs, vocabulary_json, words), "lexicon")


def encode(docs: DataFrame, path: str, compiled: bytes | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id and ids of every text. path: the tokenizer's file on the driver."""
    vocabulary, lex = _load(docs, path, compiled, words)
    key = uuid.uuid4().hex

    def run(batches):
        encoder = kept_encoder(key, vocabulary.value, lex)
        for b in batches:
            yield batch(_IDS, b["doc_id"], _lists(encoder.encode(texts(b["text"]))))

    return arrow_map(documents(docs), run, SCHEMA)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of ids; null ids are an empty text."""
    with open(path, encoding="utf-8") as f:
        vocabulary = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        encoder = Encoder(Vocabulary(vocabulary.value))
        for b in batches:
            yield batch(schema, b["doc_id"], [encoder.decode(np.array(x or [], "<u4").tobytes()) for x in b["ids"].to_pylist()])

    return arrow_map(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, compiled: bytes | None = None, words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """Encodes every text, decodes its ids again, and returns counts and digests of both, and the ids if asked, in one pass."""
    vocabulary, lex = _load(docs, path, compiled, words)
    schema = pa.schema([*_DIGESTS, pa.field("ids", pa.list_(pa.int32()))]) if with_ids else _DIGESTS
    key = uuid.uuid4().hex

    def run(batches):
        encoder = kept_encoder(key, vocabulary.value, lex)
        for b in batches:
            ids = encoder.encode(texts(b["text"]))
            lists = [_lists(ids)] if with_ids else []
            yield batch(schema, b["doc_id"], [len(x) // 4 for x in ids], [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids], *lists)

    return arrow_map(documents(docs), run, DIGEST_SCHEMA + (", ids array<int>" if with_ids else ""))
