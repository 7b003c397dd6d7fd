import base64
import hashlib
import zlib

from pyarrow import fs

from kmerloom.llm import warc
from kmerloom.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, file string, offset int")


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


ROWS = [(5, "http://a.example.com/x?q=1", "<p>é</p>"), (2, "https://A.example.com:443/y#f", "<p>é</p>"), (7, "http://b.org", ""), (8, None, None), (9, "bad://[", "<p>z</p>"), (2, "https://A.example.com/y", "<p>é</p>"), (11, "http://a.example.com/x?q=1", "other\r\n\r\nWARC/1.1"), (None, "http://c.org/", "<p>é</p>")]


def test_archive(spark):
    got = sorted((r["page_id"] or 0, r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.archive(pages(spark, ROWS)).collect())
    want = []
    first = {}
    for i, _, h in ROWS:
        first[h or ""] = min(first.get(h or "", 1 << 62), i or 1 << 61)
    for i, _, h in ROWS:
        of = first[h or ""]
        own = (i or 1 << 61) == of
        want.append((i or 0, "response" if own else "revisit", len((h or "").encode()), digest(h), None if own else of))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive(pages(spark, [])).count() == 0


def test_least_bytes(spark):
    got = {(r["page_id"], r["record_type"]) for r in warc.archive(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), least=3).collect()}
    assert got == {(1, "response"), (2, "response"), (3, "response"), (4, "revisit")}


def test_members_are_standard_gzip(spark):
    folder = scratch(spark, "warc-test")
    entries = warc.write(pages(spark, ROWS), folder).collect()
    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    for e in entries:
        name = e["file"].rpartition("/")[2]
        with store.open_input_file(f"{root}/{name}") as f:
            f.seek(e["offset"])
            raw = zlib.decompress(f.read(e["length"]), 31)
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_lookup(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p{i // 3}", f"page {i}") for i in range(200)]
    blocks = warc.index(warc.write(pages(spark, rows)), size=8)
    asked = [rows[0][1], rows[150][1], "http://nowhere.example.com/", "https://H3.example.com/p1"]
    keys = {warc.url_key(u) for u in asked}
    want = sorted((i, h) for i, u, h in rows if warc.url_key(u) in keys)
    assert want and sorted((r["page_id"], r["payload"]) for r in warc.lookup(spark, blocks, asked).collect()) == want
    assert warc.lookup(spark, blocks, ["http://nowhere.example.com/"]).count() == 0


def test_one_key_over_many_blocks_and_files(spark):
    """A third of all pages have one URL; rows that are alike get a record each; one id has several payloads."""
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h.example.com/{i}", f"page {i // 2}") for i in range(120)] + [(7, "http://hot.example.com/", "page 3")] * 2 + [(7, "http://hot.example.com/", "page 0"), ((1 << 63) - 1, "http://hot.example.com/", "page 1")]
    index = warc.index(warc.write(pages(spark, rows)), size=4)
    assert len(index.root) > 1
    got = sorted((r["page_id"], r["payload"]) for r in warc.lookup(spark, index, ["http://hot.example.com/"]).filter("record_type = 'response'").collect())
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, 1 << 70), i)
    assert got == sorted((i, h) for i, u, h in rows if "hot" in u and first[h] == i)
    every = sorted((r["page_id"], r["record_type"], r["refers_to"] or 0) for r in warc.archive(pages(spark, rows)).collect())
    assert every == sorted((i, "response" if first[h] == i else "revisit", 0 if first[h] == i else first[h]) for i, _, h in rows)


def test_keys():
    assert warc.url_key("https://m.Example.com:8080/A?b=C#d") == "com,example,m:8080)/A?b=C"
    assert warc.url_key("http://example.com") == warc.url_key("https://example.com:443/") == "com,example)/"
    assert warc.url_key(None) == ""
