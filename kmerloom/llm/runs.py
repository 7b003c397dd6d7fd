"""Periodic runs of words: all maximal repetitions of a text, by its longest-previous-factor array.

A batch of texts is one array of word numbers in which every text has symbols of its own, so that nothing is found
across texts. Prefix doubling gives suffix array and LCP; the nearest smaller positions to both sides of each suffix
give the LPF array (longest previous factor and where it is); LPF cuts each text into LZ blocks. Main's extensions
decide at each block boundary, for every period that a run over it can have, how far the period holds to both sides:
that finds all runs that touch a boundary. A run strictly inside a block is a copy of one inside the block's earlier
occurrence; runs in buckets by their start are copied from there in text order. Everything but the copying and the
walk over block lengths is vectorised over the batch.

A run is a stretch of words with smallest period q and length of at least max(LEAST, TIMES * q) that no neighbouring
word extends keeping period q. A word is dropped if a run contains it after that run's first q words.

Defined results: a null or empty text, or one of white space only, has no words and no runs; the digest of no runs and
the text of no words are those of the empty string. Texts are taken whole, in a task each, in memory of some 150 bytes a word. Repeated rows each get their
row; a null id is never rewritten by rewritten(). Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, batch, documents

LEAST, TIMES = 6, 4
#: Rounds of pointer jumping over all suffixes at once; what is still open then is walked one by one.
ROUNDS = 48

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_DIGEST = pa.schema([*(pa.field(n, pa.int64()) for n in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
DIGEST_SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Suffixes:
    """Suffix array and LCP of symbols, and the ranks of substrings of 1, 2, 4 ... symbols that occur more than once.

    The last symbol of every text occurs nowhere else. Ranks are kept for repeated substrings only.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        sa = np.argsort(symbols, kind="stable").astype(np.int32)
        fresh = np.ones(n, bool)  # whether a slot of the suffix array begins a group
        fresh[1:] = np.diff(symbols[sa]) != 0
        lcp = np.zeros(n, np.int32)
        rank = np.empty(n, np.int32)
        rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n, dtype=np.int32), 0))
        self.first, self.levels = rank.copy(), []
        open_ = np.flatnonzero(~fresh | ~np.append(fresh[1:], True)).astype(np.int32)
        width = 1
        while len(open_):
            at = sa[open_]
            key = rank[at].astype(np.int64) * n + rank[at + width]
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            sa[open_] = at
            new = np.ones(len(open_), bool)
            new[1:] = np.diff(key) != 0
            split = np.flatnonzero(new & ~fresh[open_])
            lcp[open_[split]] = width + self.forward(at[split - 1] + width, at[split] + width)
            fresh[open_[split]] = True
            rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            still = ~(new & np.append(new[1:], True))
            open_ = open_[still]
            held = np.sort(at[still])
            self.levels.append((held, rank[held]))
            width *= 2
        self.sa, self.lcp = sa, lcp

    def _same(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2^level symbols from i and from j are equal, i != j."""
        if level == 0:
            return self.first[i] == self.first[j]
        held, rank = self.levels[level - 1]
        if not len(held):
            return np.zeros(len(i), bool)
        a, b = (np.minimum(np.searchsorted(held, x), len(held) - 1) for x in (i, j))
        return (held[a] == i) & (held[b] == j) & (rank[a] == rank[b])

    def _extend(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """How many symbols agree from i and j on, going up or down."""
        out = np.zeros(len(i), np.int32)
        live = np.flatnonzero((i >= 0) & (j >= 0))
        live = live[self.first[i[live]] == self.first[j[live]]]  # most end here
        i, j = i[live], j[live]
        got = np.zeros(len(live), np.int32)
        for level in range(len(self.levels), -1, -1):
            size = 1 << level
            a, b = (i + got, j + got) if step > 0 else (i - got - size + 1, j - got - size + 1)
            low = np.minimum(a, b) >= 0
            ok = np.zeros(len(live), bool)
            ok[low] = self._same(level, a[low], b[low])
            got[ok] += size
        out[live] = got
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._extend(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self._extend(i, j, -1)

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """LPF: of each position the longest factor that also begins earlier in its text, and such an earlier position."""
        n = len(self.sa)
        lpf, source = np.zeros(n, np.int32), np.full(n, -1, np.int32)
        for down in (False, True):
            length, place = self._smaller(down)
            better = length > lpf[self.sa]
            lpf[self.sa[better]], source[self.sa[better]] = length[better], self.sa[place[better]]
        return lpf, source

    def _smaller(self, down: bool) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot the nearest slot before (or after) with a smaller position, and the LCP with it; zero if they share nothing."""
        n = len(self.sa)
        sa = self.sa[::-1] if down else self.sa
        lcp = np.append(self.lcp[1:], np.int32(0))[::-1] if down else self.lcp  # with the slot before
        to, least = np.arange(n, dtype=np.int32) - 1, lcp.copy()
        live = np.flatnonzero(least)
        live = live[sa[to[live]] > sa[live]]
        for _ in range(ROUNDS):
            if not len(live):
                break
            over = to[live]
            least[live] = np.minimum(least[live], least[over])
            to[live] = to[over]
            live = live[least[live] > 0]
            live = live[sa[to[live]] > sa[live]]
        for slot in live.tolist():  # ascending: those before are settled
            t, m = int(to[slot]), int(least[slot])
            while m and sa[t] > sa[slot]:
                t, m = int(to[t]), min(m, int(least[t]))
            to[slot], least[slot] = t, m
        return (least[::-1], n - 1 - to[::-1]) if down else (least, to)


def blocks(lpf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks of all texts; a text's last symbol is a block of its own."""
    step, out = np.maximum(lpf, 1).tolist(), []
    for i, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        while i < end:
            out.append(i)
            i += step[i]
    return np.array(out, np.int64)


def at_boundaries(s: Suffixes, starts: np.ndarray, bounds: np.ndarray, least: int, times: int) -> np.ndarray:
    """Main's extensions: (start, end, period) of all stretches over or at a block's start that are long enough, sorted."""
    size = np.diff(np.append(starts, bounds[-1]))
    low = bounds[np.searchsorted(bounds, starts, "right") - 1]  # of each block its text's start
    before = np.where(starts > low, np.append(0, size[:-1]), 0)
    reach = (before + size - 1) // (times - 1)  # a run ends within its last block, and begins less than a period before the block in front
    block = np.repeat(np.arange(len(starts)), reach)
    period = np.arange(len(block)) - np.repeat(np.cumsum(reach) - reach, reach) + 1
    at, low, high = starts[block], low[block], bounds[np.searchsorted(bounds, starts, "right")][block] - 1
    found = []
    for shift in (0, 1):  # the period's copies lie before the boundary, or begin at it
        i = at - period if shift == 0 else at
        j = i + period
        ok = (i >= low) & (j <= high)
        ok[ok] = (s.first[i[ok]] == s.first[j[ok]]) | ((i[ok] > low[ok]) & (s.first[i[ok] - 1] == s.first[j[ok] - 1]))
        i, j, p = i[ok], j[ok], period[ok]
        up, back = s.forward(i, j), s.backward(i - 1, j - 1)
        long = up + back + p >= np.maximum(least, times * p)
        found.append(np.stack([i[long] - back[long], j[long] + up[long], p[long]], 1))
    return np.unique(np.concatenate(found), axis=0)


def _copied(own: list[tuple[int, int, int]], cut: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs with those inside blocks: cut has (first, last, source) of blocks long enough to hold one, in order; a run's end is the word behind it."""
    buckets: dict[int, dict[int, int]] = {}
    for b, e, p in own:
        buckets.setdefault(b, {}).setdefault(e, p)  # the smallest period comes first
    known = sorted(buckets)
    for start, last, source in cut:
        shift, stop = start - source, source + last - start
        queue = known[bisect_left(known, source + 1) : bisect_left(known, stop)]  # sorted, so a heap
        while queue:
            b = heapq.heappop(queue)
            inside = [(e, p) for e, p in buckets[b].items() if e <= stop]
            if not inside:
                continue
            if b + shift not in buckets:
                buckets[b + shift] = {}
                insort(known, b + shift)
                if b + shift < stop:
                    heapq.heappush(queue, b + shift)
            for e, p in inside:
                buckets[b + shift].setdefault(e + shift, p)
    return [(b, e, p) for b in known for e, p in sorted(buckets[b].items())]


def runs(numbers: np.ndarray, sizes: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text that has any, sorted by start, then period.

    numbers: the texts' words as numbers from 0, one text after the other; sizes: words of each text. times: 2 at least.
    """
    texts_, n = len(sizes), len(numbers)
    words_before = np.cumsum(sizes) - sizes
    bounds = np.append(words_before + np.arange(texts_), n + texts_)
    text = np.repeat(np.arange(texts_), sizes)
    vocabulary = int(numbers.max()) + 1 if n else 0
    symbols = np.empty(n + texts_, np.int64)
    symbols[np.arange(n) + text] = text * vocabulary + numbers
    symbols[bounds[1:] - 1] = texts_ * vocabulary + np.arange(texts_)
    s = Suffixes(symbols)
    lpf, source = s.previous()
    starts = blocks(lpf, bounds)
    found = at_boundaries(s, starts, bounds, least, times)
    if not len(found):
        return {}
    size = np.diff(np.append(starts, bounds[-1]))
    holding = np.flatnonzero(size > least + 1)
    of_run, of_block = np.searchsorted(bounds, found[:, 0], "right") - 1, np.searchsorted(bounds, starts[holding], "right") - 1
    out = {}
    for t in np.unique(of_run).tolist():
        own, cut = found[slice(*np.searchsorted(of_run, [t, t + 1]))], holding[slice(*np.searchsorted(of_block, [t, t + 1]))]
        inside = [(a, z - 1, c) for a, z, c in zip(starts[cut].tolist(), (starts[cut] + size[cut]).tolist(), source[starts[cut]].tolist(), strict=True)]
        first = int(bounds[t])
        out[t] = sorted(((b - first, e - b, p) for b, e, p in _copied([tuple(r) for r in own.tolist()], inside)), key=lambda r: (r[0], r[2]))
    return out


def _words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch's texts, and how many each text has."""
    clean = pc.ascii_trim_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    cut = pc.ascii_split_whitespace(clean)
    sizes = pc.list_value_length(cut).to_numpy(zero_copy_only=False).astype(np.int64)
    empty = pc.equal(pc.binary_length(clean), 0).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(cut)
    if empty.any():
        flat = flat.filter(pa.array(~np.repeat(empty, sizes)))
        sizes[empty] = 0
    return flat, sizes


def _rewriting(ids: list[int | None], sizes: np.ndarray) -> np.ndarray | None:
    """Of each word of the batch the word that stands there after the contract's rewriting; None if nothing changes."""
    before, out = np.cumsum(sizes) - sizes, None
    for k, (i, n) in enumerate(zip(ids, sizes.tolist(), strict=True)):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out = np.arange(int(sizes.sum())) if out is None else out
        out[before[k] + a : before[k] + n] = before[k] + a + np.arange(n - a) % p
    return out


def _batches(batches, rewrite: bool, least: int, times: int):
    """(batch, words, sizes, runs by text, kept words) of each batch."""
    for b in batches:
        if not b.num_rows:
            continue
        flat, sizes = _words(b["text"])
        if rewrite and (to := _rewriting(b["doc_id"].to_pylist(), sizes)) is not None:
            flat = flat.take(pa.array(to))
        numbers = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        found = runs(numbers, sizes, least, times)
        before = np.cumsum(sizes) - sizes
        depth = np.zeros(len(numbers) + 1, np.int32)
        for t, own in found.items():
            start, length, period = (np.array(x) + 0 for x in zip(*own, strict=True))
            np.add.at(depth, before[t] + start + period, 1)
            np.add.at(depth, before[t] + start + length, -1)
        kept = np.cumsum(depth[:-1]) == 0
        yield b, flat, sizes, found, kept


def _collapsed(flat: pa.Array, sizes: np.ndarray, kept: np.ndarray) -> pa.Array:
    """Each text's kept words, joined by one space."""
    ends = np.append(0, np.cumsum(kept))[np.append(0, np.cumsum(sizes))]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length and period in words) and its text without what runs repeat.

    rewrite: end documents whose id asks for it in a periodic stretch first, as the query's contract has it.
    """

    def run(batches):
        for b, flat, sizes, found, kept in _batches(batches, rewrite, least, times):
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in found.get(t, ())] for t in range(b.num_rows)]
            yield batch(_OUT, b["doc_id"], sizes, rows, _collapsed(flat, sizes, kept).cast(pa.string()))

    return arrow_map(documents(docs), run, SCHEMA)


def greatest(own: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period; of equal ones the smallest start, then period."""
    best = own[0]
    for r in own[1:]:
        if r[1] * best[2] > best[1] * r[2]:  # own is sorted by start, then period
            best = r
    return best


def digests(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: bool = True) -> DataFrame:
    """Per document the number of runs, the greatest of them, and digests of all runs and of the collapsed text."""

    def run(batches):
        none = hashlib.sha256(b"").hexdigest()
        for b, flat, sizes, found, kept in _batches(batches, rewrite, least, times):
            best = {t: greatest(own) for t, own in found.items()}
            of = lambda f: [f(*best[t]) if t in best else None for t in range(b.num_rows)]  # noqa: E731, B023
            listed = [hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found[t]).encode()).hexdigest() if t in found else none for t in range(b.num_rows)]
            text = _collapsed(flat, sizes, kept)
            yield batch(_DIGEST, b["doc_id"], [len(found.get(t, ())) for t in range(b.num_rows)], of(lambda s, n, p: s), of(lambda s, n, p: n), of(lambda s, n, p: p), of(lambda s, n, p: 1000 * n // p), listed, [hashlib.sha256(x.as_buffer()).hexdigest() for x in text])

    return arrow_map(documents(docs), run, DIGEST_SCHEMA)
