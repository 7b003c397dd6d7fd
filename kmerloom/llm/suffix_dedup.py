"""Removal of repeated passages, after bucket-pointer refinement of suffix buckets.

A byte goes if a 200-byte string that covers it also starts anywhere else in the corpus. Every position
has the bucket of its q-gram (64 bytes); deeper buckets come from bucket identifiers of later offsets:
two q-gram buckets 64 apart give one of depth 128, and so on to the depth of 200, each identifier being
used again for the next. Sorting all positions is more than needed: any 200-byte string holds one q-gram
that is its smallest by hash, and equal strings agree on which. Only these positions (one in about 70
bytes) are sorted, by q-gram bucket first and then by the identifiers that reach to both ends of the run
of strings that chose the position.

In sorted order a look at the neighbours decides: equal identifiers, all strings of the run are repeated;
a q-gram bucket of its own, none is; else the run is cut into parts, whose bucket is a deeper string that
their strings share, and the same is done again, in the last round string by string. Positions
are dealt over tasks by ranges of the whole sort key, so a bucket of any size is spread; only each task's
first and last row meet on the driver.

Identifiers are 128 bits wide. Defined results: null and empty texts have no bytes; texts under 200 bytes
stay whole; repeated rows repeat each other and lose what they share; null ids are kept as null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch, documents, keep, texts

LENGTH, GRAM = 200, 64
WINDOW = LENGTH - GRAM + 1
#: Strings of a run that are refined together, round by round.
WIDTHS = (8, 1)
#: Bytes of texts that are hashed together: arrays that stay in the cache.
CHUNK = 1 << 17
POSITION_BITS = np.uint64(32)
NULL_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(200)
_LETTERS = _RANDOM.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 5 for x in _RANDOM.integers(1 << 40, 1 << 62, 2)]
_M = (1 << 64) - 1

ROW = "q long, u1 long, u2 long, doc_id long, t int, a int, n int, d int"
_ROW = pa.schema([("q", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int32()), ("a", pa.int32()), ("n", pa.int32()), ("d", pa.int32())])
_STATE = pa.schema([*_ROW, ("part", pa.int32()), ("edge", pa.int32()), ("repeated", pa.bool_()), ("refine", pa.bool_())])
STATE = ROW + ", part int, edge int, repeated boolean, refine boolean"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def grams(raw: np.ndarray, stream: int) -> np.ndarray:
    """Bucket identifiers of all q-grams, by doubling: depth 1, 2, 4, ... 64."""
    h, base, depth = _LETTERS[stream][raw], _BASES[stream], 1
    while depth < GRAM:
        h = h[:-depth] * np.uint64(base) + h[depth:] if len(h) > depth else h[:0]
        base, depth = base * base & _M, depth * 2
    return h


def deeper(h: np.ndarray, at: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Identifiers of a greater depth at some positions, from those of later offsets: 64 and 64 make 128, and so on; the last overlap."""
    c = np.uint64(0x9E3779B97F4A7C15)
    out = h[at]
    for offset in (*range(GRAM, depth - GRAM, GRAM), depth - GRAM):
        out = _mixed(out * c + h[at + offset])
    return out


def _identified(raw: np.ndarray, h: np.ndarray, p: np.ndarray, a: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """128 bits for each run: of the bytes from its first string's start to its last one's end, and where p lies in them."""
    c = np.uint64(0x9E3779B97F4A7C15)
    shape = ((p - a) * 256 + n).astype(np.uint64)
    return [_mixed((deeper(x, a) * c + deeper(x, a + n - 1)) * c + shape).view(np.int64) for x in (h, grams(raw, 1))]


def anchors(raw: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that choose the same q-gram: its position, the first string, how many. ends: of the texts in raw."""
    starts = len(raw) - LENGTH + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3
    key = (_mixed(h) & ~((np.uint64(1) << POSITION_BITS) - np.uint64(1))) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= WINDOW:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    chosen = (np.minimum(key[:starts], key[WINDOW - width : WINDOW - width + starts]) & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)
    whole = np.ones(starts + 1, bool)  # strings within one text
    for e in ends[:-1]:
        whole[max(0, e - LENGTH + 1) : e] = False
    whole[starts] = False
    new = np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (whole[1:starts] != whole[: starts - 1])])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [starts]]))
    real = whole[first]
    return chosen[first[real]], first[real], count[real]


def _chunks(raws: list[bytes]) -> Iterator[tuple[int, int]]:
    """Consecutive texts of about CHUNK bytes."""
    first = size = 0
    for i, r in enumerate(raws):
        size += len(r)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(raws):
        yield first, len(raws)


def positions(docs: DataFrame) -> DataFrame:
    """A row for each chosen position: its buckets, its document, the run of strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [t.encode() for t in texts(b["text"])]
            ids, tags = b["doc_id"].to_numpy(), b["t"].to_numpy()
            for i, j in _chunks(raws):
                ends = np.cumsum([len(r) for r in raws[i:j]])
                raw = np.frombuffer(b"".join(raws[i:j]), np.uint8)
                if len(raw) < LENGTH:
                    continue
                h = grams(raw, 0)
                p, a, n = anchors(raw, ends, h)
                of = np.searchsorted(ends, a, "right")
                begin = np.concatenate([[0], ends])[of]
                yield batch(_ROW, *map(pa.array, (_mixed(h[p]).view(np.int64), *_identified(raw, h, p, a, n), ids[i:j][of], tags[i:j][of], (a - begin).astype(np.int32), n.astype(np.int32), (p - a).astype(np.int32))))

    return arrow_map(docs, run, ROW)


def _decide(q, u1, u2) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in sorted order, all but the first and the last: whether the run repeats, whether its strings are to be refined."""
    same_q = q[1:] == q[:-1]
    same_u = same_q & (u1[1:] == u1[:-1]) & (u2[1:] == u2[:-1])
    repeated = same_u[1:] | same_u[:-1]
    return repeated, (same_q & ~same_u)[1:] | (same_q & ~same_u)[:-1]


def states(rows: DataFrame) -> DataFrame:
    """doc_id, t, a, n, d, repeated, refine of the runs that are not single already. They are stored: a lost executor costs no second sort."""
    spark = rows.sparkSession
    order = ["q", "u1", "u2", "doc_id", "t", "a"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = _ROW.names
        carry: pa.Table | None = None
        first = True
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.Table.from_batches([b]).cast(_ROW)
            t = own if carry is None else pa.concat_tables([carry, own])
            if first and t.num_rows > 1:
                yield _edge(t.slice(0, 2), 0, part, 0)
                first = False
            if t.num_rows > 2:
                repeated, refine = _decide(*(t[c].to_numpy() for c in ("q", "u1", "u2")))
                told = np.flatnonzero(repeated | refine)
                middle = t.slice(1, t.num_rows - 2).take(pa.array(told))
                n = len(told)
                yield batch(_STATE, *(middle[c].combine_chunks() for c in _ROW.names), np.full(n, part), np.full(n, -1), repeated[told], refine[told])
            carry = t.slice(max(0, t.num_rows - 2))
        if carry is not None:
            yield _edge(carry, carry.num_rows - 1, part, 1)

    told = keep(arrow_map(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), run, STATE), "passages-found")
    edges = told.filter("edge >= 0").orderBy("part", "edge").collect()
    inner = told.filter("edge < 0").select("doc_id", "t", "a", "n", "d", "repeated", "refine")
    return inner.unionByName(spark.createDataFrame(_edges(edges), "doc_id long, t int, a int, n int, d int, repeated boolean, refine boolean"))


def _edge(rows: pa.Table, at: int, part: int, edge: int) -> pa.RecordBatch:
    """The first or last row of a task, with what its neighbour within the task says; one row alone is a last row."""
    keys = list(zip(*(rows[c].to_pylist() for c in ("q", "u1", "u2")), strict=True))
    same = len(keys) > 1 and keys[0][0] == keys[1][0]
    row = rows.slice(at, 1)
    return batch(_STATE, *(row[c].combine_chunks() for c in _ROW.names), [part], [edge], [same and keys[0] == keys[1]], [same and keys[0] != keys[1]])


def _edges(rows: list) -> list[tuple]:
    """First and last rows of all tasks, in order, held against their neighbours across tasks."""
    told = [[r["repeated"], r["refine"]] for r in rows]
    for i in range(1, len(rows)):
        a, z = rows[i - 1], rows[i]
        if a["part"] != z["part"] and a["q"] == z["q"]:
            k = 0 if (a["u1"], a["u2"]) == (z["u1"], z["u2"]) else 1
            told[i - 1][k] = told[i][k] = True
    return [(r["doc_id"], r["t"], r["a"], r["n"], r["d"], *x) for r, x in zip(rows, told, strict=True) if any(x)]


def _with_runs(docs: DataFrame, found: DataFrame, how: str, *columns: str) -> DataFrame:
    """Documents with the runs found in them. A document has no more runs than bytes."""
    runs = found.groupBy("doc_id", "t").agg(F.collect_list(F.struct(*columns)).alias("runs"))
    return docs.join(runs.hint("shuffle_hash"), ["doc_id", "t"], how).select("doc_id", "t", "text", "runs")


def refined(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """Rows like those of positions(), for parts of the runs in found: of up to ``width`` strings, cut at equal distances from the q-gram.

    A part's bucket is what all strings at its distances have in common, 200 - width + 1 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, t, text, runs in zip(*(b[c].to_pylist() for c in ("doc_id", "t", "text", "runs")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                h = grams(raw, 0)
                a0, n0, d0 = (np.array([r[c] for r in runs], np.int64) for c in ("a", "n", "d"))
                s = np.repeat(a0 - np.concatenate([[0], np.cumsum(n0)])[:-1], n0) + np.arange(n0.sum())
                p = np.repeat(a0 + d0, n0)
                part = (p - s) // width
                new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (part[1:] != part[:-1]) | (s[1:] != s[:-1] + 1)]))
                n = np.diff(np.concatenate([new, [len(s)]]))
                p, a, part = p[new], s[new], part[new]
                q = _mixed(deeper(h, p - part * width, LENGTH - width + 1)).view(np.int64)
                m = len(a)
                out.append((q, *_identified(raw, h, p, a, n), np.full(m, doc_id), np.full(m, t, np.int32), a.astype(np.int32), n.astype(np.int32), (p - a).astype(np.int32)))
            if out:
                yield batch(_ROW, *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True)))

    return arrow_map(_with_runs(docs, found, "inner", "a", "n", "d"), run, ROW)


OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans_of(runs: list[dict]) -> list[list[int]]:
    """Maximal byte ranges that runs of strings cover."""
    out: list[list[int]] = []
    for a, n in sorted((r["a"], r["n"]) for r in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - 1 + LENGTH)
        else:
            out.append([a, a + n - 1 + LENGTH])
    return out


def remove_repeats(docs: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, the removed byte ranges and the bytes that stay, or their digest."""
    d = documents(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc_id"), F.hash(F.coalesce("text", F.lit(""))).alias("t"), F.coalesce("text", F.lit("")).alias("text"))
    found = states(positions(d))
    repeated = found.filter("repeated")
    for width in WIDTHS:
        found = states(refined(d, found.filter("refine"), width))
        repeated = repeated.unionByName(found.filter("repeated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(b["text"].to_pylist(), b["runs"].to_pylist(), strict=True):
                raw = text.encode()
                spans = spans_of(runs or ())
                edges = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                rows.append((len(raw), len(raw) - len(kept), spans, kept))
            ids = pa.array([None if i == NULL_ID else i for i in b["doc_id"].to_pylist()], pa.int64())
            size, gone, spans, kept = zip(*rows, strict=True) if rows else ((),) * 4
            if digests:
                yield batch(_DIGEST, ids, size, gone, [len(s) for s in spans], [hashlib.sha256(k).hexdigest() for k in kept])
            else:
                yield batch(_OUT, ids, size, gone, [[{"start": x, "end": y} for x, y in s] for s in spans], kept)

    return arrow_map(_with_runs(d, repeated, "left", "a", "n"), run, DIGEST if digests else OUT)
