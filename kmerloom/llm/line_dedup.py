"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased, as a 128-bit hash. Keys of at
least ten code points that two or more documents hold lose their lines everywhere but in the document
with the smallest id. The exact table counts, per key, the documents that hold it; a cuckoo filter for
each shard of keys holds the repeated ones. Documents are first held against the filters, and only lines
that pass are joined with the exact table, so false positives cost a row and change nothing. Filters that
are small together go to all executors; larger ones stay with their shard, and lines go to them.

``LineStore`` is what every call goes through. It keeps postings, counts and filters as segments in the shared
folder: inserting documents writes their postings and the new counts of the keys that they hold, deleting
writes the ids and the new counts of their keys, and keys enter or leave the filters of their shards as they
pass two; what a change doesn't touch isn't written again. Segments are merged when there are many.

Defined results: a null or empty text is one empty line; rows of one id are one document; null ids are one
document, after all others, and so is 2^63 - 1, which stands for them; short lines always stay; all copies within
the owner stay; documents whose id the store holds already are not inserted again.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, batch, discard, documents, keep, texts

MIN_CHARS = 10
#: Shards of keys: these at least, more where one would hold more keys than SHARD_KEYS.
SHARDS, SHARD_KEYS = 64, 500_000
#: Filters larger than this together aren't sent to the executors; lines are then dealt by shard and held against its filter there.
FILTER_BYTES = 64 << 20
#: Segments of a table of the store before they are merged.
SEGMENTS = 8
NULL_ID = (1 << 63) - 1

_STRIP = SPACE.encode()
_KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_sha256", pa.string())])


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """16 bytes, or None for lines that are too short to be dropped."""
    key = line.strip(_STRIP).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(key)


def text_keys(raw: bytes) -> set[bytes]:
    return {k for line in raw.split(b"\n") if (k := line_key(line)) is not None}


class CuckooFilter:
    """Buckets of four 16-bit fingerprints. Full filters get a larger one behind them."""

    def __init__(self, data: bytes | None = None, expected: int = 64):
        if data:
            self.tables, at = [], 0
            while at < len(data):
                (n,) = struct.unpack_from("<q", data, at)
                self.tables.append(np.frombuffer(data, np.uint16, 4 * n, at + 8).reshape(n, 4).copy())
                at += 8 + 8 * n
        else:
            self.tables = [self._empty(expected)]

    @staticmethod
    def _empty(expected: int) -> np.ndarray:
        return np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, expected) / 3.2)))), 4), np.uint16)

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<q", len(t)) + t.tobytes() for t in self.tables)

    @staticmethod
    def _places(k1: np.ndarray, k2: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = ((k2.astype(np.uint64) % np.uint64(65535)) + np.uint64(1)).astype(np.uint16)
        first = ((k1.astype(np.uint64) >> np.uint64(17)) & np.uint64(n - 1)).astype(np.int64)
        return mark, first, first ^ CuckooFilter._step(mark, n)

    @staticmethod
    def _step(mark, n: int):
        return (np.asarray(mark).astype(np.int64) * 0x5BD1E995) & (n - 1)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(k1), bool)
        for t in self.tables:
            mark, a, z = self._places(k1, k2, len(t))
            hit |= (t[a] == mark[:, None]).any(1) | (t[z] == mark[:, None]).any(1)
        return hit

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Each key once: the exact table says which keys are new."""
        while len(k1):
            t = self.tables[-1]
            mark, a, z = self._places(k1, k2, len(t))
            left = np.arange(len(k1))
            for at in (a, z):  # whatever finds a free slot in one go
                order = left[np.argsort(at[left], kind="stable")]
                b = at[order]
                nth = np.arange(len(b)) - np.searchsorted(b, b, "left")
                free = (t[b] == 0).sum(1)
                fits = nth < free
                slots = np.argsort(t[b[fits]] != 0, 1, kind="stable")
                t[b[fits], slots[np.arange(fits.sum()), nth[fits]]] = mark[order[fits]]
                left = order[~fits]
            stuck = [i for i in left if not self._kick(t, int(mark[i]), int(a[i]))]
            if not stuck:
                return
            self.tables.append(self._empty(max(2 * 3 * len(t), len(stuck))))
            k1, k2 = k1[stuck], k2[stuck]

    def _kick(self, t: np.ndarray, mark: int, at: int) -> bool:
        trail = []
        for turn in range(200):
            row = t[at]
            if (free := np.flatnonzero(row == 0)).size:
                row[free[0]] = mark
                return True
            slot = turn % 4
            trail.append((at, slot, mark))
            mark, row[slot] = int(row[slot]), mark
            at ^= int(self._step(mark, len(t)))
        for at, slot, put in reversed(trail):  # as it was
            mark, t[at, slot] = int(t[at, slot]), mark
            assert mark == put
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> None:
        """Keys that were inserted; one fingerprint each."""
        for i in range(len(k1)):
            for t in reversed(self.tables):
                mark, a, z = self._places(k1[i : i + 1], k2[i : i + 1], len(t))
                at = next((b for b in (int(a[0]), int(z[0])) if (t[b] == mark[0]).any()), None)
                if at is not None:
                    t[at, int(np.flatnonzero(t[at] == mark[0])[0])] = 0
                    break


def _pairs(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _ids(docs: DataFrame) -> DataFrame:
    return documents(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))


def postings(docs: DataFrame, filters: dict[int, bytes] | None = None, shards: int = SHARDS) -> DataFrame:
    """(k1, k2, doc_id) for each key of each document, only of keys that may be repeated where filters are given."""
    given = docs.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {s: CuckooFilter(f) for s, f in given.value.items()} if given is not None else None
        for b in batches:
            ids: list[int] = []
            keys: list[bytes] = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                own = text_keys(text.encode())
                keys += own
                ids += [doc_id] * len(own)
            k1, k2 = _pairs(keys)
            of = np.array(ids, np.int64)
            if known is not None and len(keys):
                shard, may = k1 % shards, np.zeros(len(keys), bool)
                order = np.argsort(shard, kind="stable")
                edges = np.flatnonzero(np.diff(shard[order], prepend=-1, append=shards))
                for x, y in zip(edges, edges[1:], strict=False):
                    at = order[x:y]
                    if (f := known.get(int(shard[at[0]]))) is not None:
                        may[at] = f.contains(k1[at], k2[at])
                k1, k2, of = k1[may], k2[may], of[may]
            for i in range(0, len(of), 100_000):
                yield batch(_KEYS, *(pa.array(x[i : i + 100_000]) for x in (k1, k2, of)))

    return arrow_map(_ids(docs), run, "k1 long, k2 long, doc_id long")


def probe_by_shard(posted: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """Of (k1, k2, doc_id), rows whose key its shard's filter holds: each shard's filter comes first, then its rows, in pieces."""
    rows = filters.select("shard", F.lit(0).alias("turn"), "filter", *(F.lit(None).cast("long").alias(n) for n in _KEYS.names)).unionByName(posted.select(_shard(shards), F.lit(1).alias("turn"), F.lit(None).cast("binary").alias("filter"), *_KEYS.names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            shard, turn = b["shard"].to_numpy(), b["turn"].to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (turn[1:] != turn[:-1]), [True]]))
            for x, y in zip(edges, edges[1:], strict=False):
                if not turn[x]:
                    at, held = shard[x], CuckooFilter(b["filter"][int(x)].as_py())
                elif shard[x] == at:
                    part = pa.RecordBatch.from_arrays([b[n].slice(x, y - x) for n in _KEYS.names], schema=_KEYS)
                    yield part.filter(pa.array(held.contains(part["k1"].to_numpy(), part["k2"].to_numpy())))

    return arrow_map(rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "turn"), run, "k1 long, k2 long, doc_id long")


def reference_counts(posted: DataFrame) -> DataFrame:
    """k1, k2, n (documents that hold the key), owner and last (smallest and largest of them)."""
    return posted.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"))


def _shard(shards: int):
    return F.pmod("k1", F.lit(shards)).alias("shard")


def drops(docs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, keys) for the documents that lose lines."""
    repeated = counts.filter("owner < last").select("k1", "k2", "owner")
    if (filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) <= filter_bytes:
        may = postings(docs, {r["shard"]: bytes(r["filter"]) for r in filters.collect()}, shards)
    else:
        may = probe_by_shard(postings(docs), filters, shards)
    mine = may.join(repeated, ["k1", "k2"]).filter("doc_id > owner")
    return mine.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def apply_drops(docs: DataFrame, dropped: DataFrame, digests: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the text that stays or its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(texts(b["text"]), b["keys"].to_pylist(), strict=True):
                lines = text.encode().split(b"\n")
                gone = {struct.pack("<qq", k["k1"], k["k2"]) for k in keys or ()}
                stay = [x for x in lines if line_key(x) not in gone] if gone else lines
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                left = b"\n".join(stay)
                kept.append(hashlib.sha256(left).hexdigest() if digests else left.decode())
            ids = pa.array([None if i == NULL_ID else i for i in b["doc_id"].to_pylist()], pa.int64())
            yield batch(_DIGEST if digests else _OUT, ids, n_lines, n_dropped, kept)

    joined = _ids(docs).join(dropped.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "keys")
    return arrow_map(joined, run, f"doc_id long, n_lines long, n_dropped long, {'kept_sha256' if digests else 'text'} string")


def _stored(docs: DataFrame) -> LineStore:
    store = LineStore(docs.sparkSession)
    store.insert(docs)
    return store


def line_dedup(docs: DataFrame, digests: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Drops repeated lines of all documents at once: they are inserted into an empty store and held against it."""
    return _stored(docs).apply(docs, digests, filter_bytes)


def clean_text(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """The rows, whole, with the text that stays; ``n_chars``, where there is one, counts it again. Null texts stay null.

    Rows that are alike, and all rows of one id, are one document, which loses what a smaller id holds.
    """
    dropped = _stored(docs).drops(docs, filter_bytes).withColumnsRenamed({"doc_id": "__id", "keys": "__keys"})
    names = docs.columns
    joined = docs.join(dropped.hint("shuffle_hash"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)) == F.col("__id"), "left").drop("__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.select(names)
            text = []
            for own, keys in zip(b["text"].to_pylist(), b["__keys"].to_pylist(), strict=True):
                gone = {struct.pack("<qq", k["k1"], k["k2"]) for k in keys or ()}
                text.append(b"\n".join(x for x in own.encode().split(b"\n") if line_key(x) not in gone).decode() if own and gone else own)
            out = out.set_column(names.index("text"), "text", pa.array(text, out.schema.field("text").type))
            if "n_chars" in names:
                kind = out.schema.field("n_chars").type
                out = out.set_column(names.index("n_chars"), "n_chars", pa.array([None if t is None else len(t) for t in text], kind))
            yield out

    return arrow_map(joined, run, docs.schema)


class LineStore:
    """An incremental index of lines. Tables are lists of segments; of a key's counts, and of a shard's filter, the latest version holds."""

    def __init__(self, spark: SparkSession, shards: int = SHARDS):
        self.spark, self.shards, self.turn, self.repeated = spark, shards, 0, 0
        self.segments: dict[str, list[DataFrame]] = {"held": [], "posted": [], "gone": [], "counts": [], "filters": []}

    def _all(self, name: str, schema: str) -> DataFrame:
        out = None
        for s in self.segments[name]:
            out = s if out is None else out.unionByName(s, allowMissingColumns=True)
        return self.spark.createDataFrame([], f"{schema}, turn int") if out is None else out

    def _alive(self, name: str, schema: str) -> DataFrame:
        """Rows of documents that haven't been deleted since."""
        rows = self._all(name, schema)
        if self.segments["gone"]:
            last = self._all("gone", "doc_id long").groupBy("doc_id").agg(F.max("turn").alias("__until"))
            rows = rows.join(last, "doc_id", "left").filter("__until is null or turn > __until").drop("__until")
        return rows.drop("turn")

    @property
    def posted(self) -> DataFrame:
        return self._alive("posted", "k1 long, k2 long, doc_id long")

    @property
    def counts(self) -> DataFrame:
        """k1, k2, n, owner, last of all keys that a document holds."""
        rows = self._all("counts", "k1 long, k2 long, n long, owner long, last long")
        if len(self.segments["counts"]) > 1:
            rows = rows.groupBy("k1", "k2").agg(F.max_by(F.struct("n", "owner", "last"), "turn").alias("now")).select("k1", "k2", "now.*")
        return rows.filter("n > 0").select("k1", "k2", "n", "owner", "last")

    @property
    def filters(self) -> DataFrame:
        rows = self._all("filters", "shard long, filter binary")
        if len(self.segments["filters"]) > 1:
            rows = rows.groupBy("shard").agg(F.max_by("filter", "turn").alias("filter"))
        return rows.select("shard", "filter")

    def _add(self, name: str, rows: DataFrame) -> DataFrame:
        """A further segment; many are merged to one."""
        table = keep(rows.withColumn("turn", F.lit(self.turn)), f"line-{name}")
        self.segments[name].append(table)
        if len(self.segments[name]) > SEGMENTS and name != "gone":
            one = keep({"held": self._held, "posted": lambda: self.posted, "counts": lambda: self.counts, "filters": lambda: self.filters}[name]().withColumn("turn", F.lit(self.turn)), f"line-{name}")
            self.segments[name] = [one]
        return table.drop("turn")

    def _held(self) -> DataFrame:
        return self._alive("held", "doc_id long")

    def insert(self, docs: DataFrame) -> None:
        """Documents whose ids the store doesn't hold yet; others are left out."""
        self.turn += 1
        d = _ids(docs)
        if self.segments["held"]:
            d = d.join(self._held(), "doc_id", "left_anti")
        ids = self._add("held", d.groupBy("doc_id").agg(F.count("*").alias("rows")))
        new = postings(d)
        if not ids.filter("rows > 1").isEmpty():
            new = new.distinct()  # rows of one id count once
        first = not self.segments["counts"]
        new = self._add("posted", new)
        added = reference_counts(new)
        if first:
            self._count(added.withColumn("was", F.lit(False)))
            return
        added = keep(added, "line-added")
        old = self.counts.join(added.select("k1", "k2"), ["k1", "k2"], "left_semi")
        merged = old.withColumn("was", F.col("owner") < F.col("last")).unionByName(added.withColumn("was", F.lit(False))).groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("owner").alias("owner"), F.max("last").alias("last"), F.bool_or("was").alias("was"))
        self._count(merged)
        discard(added)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes back the documents of these ids; lines they owned go to the next smallest id."""
        gone = keep(doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id")).distinct(), "line-ids")
        touched = keep(self.posted.join(gone, "doc_id", "left_semi").select("k1", "k2").distinct(), "line-touched")
        before = self.counts.join(touched, ["k1", "k2"], "left_semi").select("k1", "k2", (F.col("owner") < F.col("last")).alias("was"))
        before = keep(before, "line-before")
        self.turn += 1
        self._add("gone", gone)
        left = reference_counts(self.posted.join(touched, ["k1", "k2"], "left_semi"))
        self._count(before.join(left, ["k1", "k2"], "left").fillna(0, ["n"]))
        discard(gone, touched, before)

    def _count(self, rows: DataFrame) -> None:
        """Stores new counts (k1, k2, n, owner, last, was) of some keys, and lets keys into filters or out of them. was: whether a key was repeated."""
        now = F.col("n") > 0, F.coalesce(F.col("owner") < F.col("last"), F.lit(False))
        rows = self._add("counts", rows.select("k1", "k2", "n", "owner", "last", "was"))
        changes = rows.withColumn("enters", now[0] & now[1]).filter("enters <> was").select("k1", "k2", "enters")
        counted = changes.agg(F.count_if("enters"), F.count_if(~F.col("enters"))).first()
        self.repeated += counted[0] - counted[1]
        if (wanted := max(self.shards, self.repeated // SHARD_KEYS)) > (self.shards if not self.segments["filters"] else 2 * self.shards):
            self.shards, self.segments["filters"] = wanted, []  # more shards: all filters anew
            changes = self.counts.filter("owner < last").select("k1", "k2", F.lit(True).alias("enters"))
        changes = changes.withColumn("shard", _shard(self.shards))

        def fresh(change: pd.DataFrame) -> pd.DataFrame:
            f = CuckooFilter(expected=len(change))
            f.insert(change["k1"].to_numpy(), change["k2"].to_numpy())
            return pd.DataFrame({"shard": [int(change["shard"].iloc[0])], "filter": [f.to_bytes()]})

        def changed(held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            if not len(change):
                return pd.DataFrame({"shard": [], "filter": []})
            f = CuckooFilter(bytes(held["filter"].iloc[0]) if len(held) else None, len(change))
            for enters, do in ((False, f.delete), (True, f.insert)):
                c = change[change["enters"] == enters]
                do(c["k1"].to_numpy(np.int64), c["k2"].to_numpy(np.int64))
            return pd.DataFrame({"shard": [int(change["shard"].iloc[0])], "filter": [f.to_bytes()]})

        schema = "shard long, filter binary"
        if self.segments["filters"]:
            self._add("filters", self.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(changed, schema))
        else:
            self._add("filters", changes.groupBy("shard").applyInPandas(fresh, schema))

    def drops(self, docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(doc_id, keys) for documents that lose lines."""
        return drops(docs, self.counts, self.filters, self.shards, filter_bytes)

    def apply(self, docs: DataFrame, digests: bool = False, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """What is left of documents that the store holds."""
        return apply_drops(docs, self.drops(docs, filter_bytes), digests)
