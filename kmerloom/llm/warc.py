"""WARC archives with a two-level capture index.

Writing: each task writes one archive of gzip members, a record for each page; pages whose payload an
earlier page id has are revisit records. Index entries are sorted by reversed-host URL key and page id over
all archives; each task packs its range of them into a file of compressed blocks, with a sparse directory of
the blocks' first and last keys behind them. A root of one row for each such file, bounded by the number of
tasks, says which file to look in. Keys that are looked for are dealt by the root, sorted, searched for in the
directory and in the block, both by bisection; the records found are read by ranges, archive by archive.

Archives are files in the folder that driver and executors share, reached through pyarrow's file systems;
their names hold a random part, and only names that a finished task has handed over are ever read, so
tasks may fail or run twice.

Defined results: a null page is an empty payload; a null URL sorts first, under an empty key; rows of
one page id are all responses if theirs is the smallest id of the payload; null ids sort last; rows that
are alike get a record each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, batch, keep, scratch

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: Entries of a block, and those of an index file where the input is large.
BLOCK_ENTRIES, FILE_ENTRIES = 1000, 2_000_000
OPEN_FILES = 32
#: Bytes of an archive that one task reads.
READ_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"

_ENTRY = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_ROOT = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])
RECORD_SCHEMA = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"
_RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.string())])


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query, lower-cased host; no scheme, no fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url if "//" in url else f"//{url}")
        host = (u.hostname or "").rstrip(".")
        port = u.port
    except ValueError:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record, compressed as a gzip member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-cased name, and the payload (empty for revisits)."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] == "response" else b""


def revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """digest and bytes of the payloads that several ids have, and the smallest of them. Only digests are shuffled."""
    small = pages.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("least_id"), F.max("page_id").alias("last"), F.count_if(F.col("page_id").isNull()).alias("nulls"))
    return small.filter("least_id < last or least_id is not null and nulls > 0").select("digest", "bytes", "least_id")


def _pages(pages: DataFrame) -> DataFrame:
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return p.withColumns({"digest": F.sha1("html"), "bytes": F.octet_length("html")})


def write(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Writes archives; returns the index entries (key, page_id, file, offset, length), stored once."""
    folder = folder or scratch(pages.sparkSession, "warc")
    p = _pages(pages)
    later = (F.col("page_id") > F.col("least_id")) | F.col("page_id").isNull()
    dealt = p.join(revisits(p, least).hint("shuffle_hash"), ["digest", "bytes"], "left").select("page_id", "url", "html", F.when(later, F.col("least_id")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, offset = None, f"{uuid.uuid4().hex}.warc.gz", 0
        store, root = fs.FileSystem.from_uri(folder)
        try:
            for b in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(b[n].to_pylist() for n in ("page_id", "url", "html", "refers_to")), strict=True):
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = record(page_id, url, html.encode(), refers_to)
                    out.write(member)
                    rows.append((url_key(url), page_id, f"{folder}/{name}", offset, len(member)))
                    offset += len(member)
                if rows:
                    yield batch(_ENTRY, *zip(*rows, strict=True))
        finally:
            if out is not None:
                out.close()

    return keep(arrow_map(dealt, run, "key string, page_id long, file string, offset long, length long"), "warc-entries")


def _rank(key: str, page_id: int | None) -> list:
    """What entries are sorted by: null ids after all others."""
    return [key, page_id is None, page_id or 0]


def _pack(rows: list) -> bytes:
    return zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode(), 6)


@dataclass
class Index:
    """The root: of each index file, in order, its first and last rank, its name, and where its directory is."""

    root: list[tuple[list, list, str, int, int]]


def index(entries: DataFrame, size: int = BLOCK_ENTRIES) -> Index:
    """Files of compressed blocks of entries in order, each with its directory: rows of first rank, last rank, offset, length."""
    folder = scratch(entries.sparkSession, "warc-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, offset, n = None, f"{uuid.uuid4().hex}.idx", 0, 0
        rows: list[tuple] = []
        directory: list[tuple] = []

        def block(of: list[tuple]) -> None:
            nonlocal out, offset, n
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            data = _pack(of)
            out.write(data)
            directory.append((_rank(*of[0][:2]), _rank(*of[-1][:2]), offset, len(data)))
            offset, n = offset + len(data), n + len(of)

        try:
            for b in batches:
                rows += zip(*(b[c].to_pylist() for c in _ENTRY.names), strict=True)
                while len(rows) >= size:
                    block(rows[:size])
                    rows = rows[size:]
            if rows:
                block(rows)
            if directory:
                data = _pack(directory)
                out.write(data)
        finally:
            if out is not None:
                out.close()
        if directory:
            yield batch(_ROOT, [json.dumps(directory[0][0])], [json.dumps(directory[-1][1])], [f"{folder}/{name}"], [offset], [len(data)], [n])

    order = ["key", F.col("page_id").isNull(), "page_id", "file", "offset"]
    n = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), entries.count() // FILE_ENTRIES)
    dealt = entries.repartitionByRange(n, *order).sortWithinPartitions(*order)
    root = arrow_map(dealt, run, "first string, last string, file string, offset long, length long, n long").collect()
    return Index(sorted((json.loads(r["first"]), json.loads(r["last"]), r["file"], r["offset"], r["length"]) for r in root))


def unpack(data: bytes) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


class _Files:
    """Range reads from archives, few of them open at a time."""

    def __init__(self):
        self.open: dict = {}

    def read(self, name: str, offset: int, length: int) -> bytes:
        f = self.open.pop(name, None)
        if f is None:
            if len(self.open) >= OPEN_FILES:
                self.open.pop(next(iter(self.open))).close()
            store, path = fs.FileSystem.from_uri(name)
            f = store.open_input_file(path)
        self.open[name] = f
        f.seek(offset)
        return f.read(length)


def _between(firsts: list, lasts: list, low: list, high: list) -> range:
    """Of consecutive ranges, in order, those that may hold what lies between low and high."""
    return range(bisect_left(lasts, low), bisect_right(firsts, high))


def _bounds(key: str, page_id: int | None, every: bool) -> tuple[list, list]:
    """The ranks between which entries of a key lie, of every page or of one."""
    return ([key, False, -(1 << 63)], [key, True, 0]) if every else (_rank(key, page_id),) * 2


class _Searcher:
    """Bisects the directory of one index file after the other, and its blocks; holds one directory and one block."""

    def __init__(self, ix: Index):
        self.root, self.files, self.part, self.block = ix.root, _Files(), -1, -1

    def find(self, part: int, low: list, high: list) -> Iterator[list]:
        name = self.root[part][2]
        if part != self.part:
            directory = unpack(self.files.read(name, *self.root[part][3:5]))
            self.part, self.block, self.directory = part, -1, directory
            self.firsts, self.lasts = [d[0] for d in directory], [d[1] for d in directory]
        for i in _between(self.firsts, self.lasts, low, high):
            if i != self.block:
                self.block, self.entries = i, unpack(self.files.read(name, *self.directory[i][2:4]))
                self.ranks = [_rank(*e[:2]) for e in self.entries]
            for j in range(bisect_left(self.ranks, low), bisect_right(self.ranks, high)):
                yield self.entries[j]


def locate(ix: Index, wanted: DataFrame) -> DataFrame:
    """file, offset and length of the records of wanted rows (url, page_id, every); rows that are alike are looked for once."""
    given = wanted.sparkSession.sparkContext.broadcast(ix)
    dealt = pa.schema([("part", pa.int32()), ("key", pa.string()), ("page_id", pa.int64()), ("every", pa.bool_())])
    found = pa.schema([(n, _ENTRY.field(n).type) for n in ("file", "offset", "length")])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [r[0] for r in given.value.root], [r[1] for r in given.value.root]
        for b in batches:
            rows = [(part, key, page_id, every) for url, page_id, every in zip(*(b[n].to_pylist() for n in ("url", "page_id", "every")), strict=True) for key in [url_key(url)] for part in _between(firsts, lasts, *_bounds(key, page_id, every))]
            yield batch(dealt, *(zip(*rows, strict=True) if rows else [[]] * len(dealt)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, last = _Searcher(given.value), None
        for b in batches:
            rows = []
            for w in zip(*(b[n].to_pylist() for n in dealt.names), strict=True):
                if w != last:
                    rows += [e[2:5] for e in searcher.find(w[0], *_bounds(*w[1:]))]
                last = w
            yield batch(found, *(zip(*rows, strict=True) if rows else [[]] * len(found)))

    parts = max(1, len(ix.root))
    by_part = arrow_map(wanted.select("url", "page_id", "every"), deal, "part int, key string, page_id long, every boolean").repartitionById(parts, F.col("part"))
    return arrow_map(by_part.sortWithinPartitions("part", "key", F.col("page_id").isNull(), "page_id", "every"), search, "file string, offset long, length long")


def fetch(located: DataFrame) -> DataFrame:
    """The records at (file, offset, length), by range reads in the order of each archive. Payloads of revisits are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for b in batches:
            rows = []
            for name, offset, length in zip(*(b[n].to_pylist() for n in ("file", "offset", "length")), strict=True):
                fields, payload = parse(files.read(name, offset, length))
                digest, response = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "response"
                if response and (digest32(payload) != digest or len(payload) != int(fields["x-payload-length"])):
                    raise ValueError(f"a payload at {offset} of {name} doesn't match its digest")
                page_id, refers = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((int(page_id) if page_id else None, fields.get("warc-target-uri"), fields["warc-type"], int(fields["x-payload-length"]), digest, int(refers) if refers else None, payload.decode() if response else None))
            yield batch(_RECORD, *(zip(*rows, strict=True) if rows else [[]] * len(_RECORD)))

    piece = F.floor(F.col("offset") / READ_BYTES)
    return arrow_map(located.repartition("file", piece).sortWithinPartitions("file", "offset"), run, RECORD_SCHEMA)


def lookup(spark: SparkSession, ix: Index, urls: list[str]) -> DataFrame:
    """All records whose key is that of one of the URLs."""
    asked = sorted({url_key(u): u for u in urls}.values())
    return fetch(locate(ix, spark.createDataFrame([(u, None, True) for u in asked], "url string, page_id long, every boolean")))


def archive(pages: DataFrame, folder: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages, indexes the archives, and looks each page up again."""
    ix = index(write(pages, folder, least))
    return fetch(locate(ix, pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"), F.lit(False).alias("every"))))
