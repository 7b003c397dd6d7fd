import hashlib
import random
import struct

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    order = lambda i: float("inf") if i is None else i
    owners: dict = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                owners.setdefault(key(line), set()).add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if order(i) == min(owners.get(key(x), {order(i)}))]
        out.append((order(i), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def shown(df):
    return sorted((float("inf") if r["doc_id"] is None else r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect())


def some(corpus, edges):
    lines = ["A common line of text", " a COMMON line of text\t", "ten chars!", "ninechars", "é" * 10, "é" * 9, " padded line here"]
    r = random.Random(4)
    return corpus[:60] + edges + [(2_000 + i, "\n".join(r.choices(lines, k=5))) for i in range(40)]


def test_against_plain(spark, docs, corpus, edges):
    rows = some(corpus, edges)
    want = plain(rows)
    assert shown(line_dedup.line_dedup(docs(rows), True)) == want
    assert shown(line_dedup.line_dedup(docs(rows), True, filter_bytes=0)) == want  # filters too large to send


def test_store_is_reversible(spark, docs, corpus, edges):
    rows = some(corpus, edges)
    first, second = rows[::2], [r for r in rows[1::2] if r[0] not in {i for i, _ in rows[::2]}]
    store = line_dedup.LineStore(spark, shards=3)
    store.insert(docs(first))
    assert shown(store.apply(docs(first), True)) == plain(first)
    store.insert(docs(second))
    assert shown(store.apply(docs(first + second), True)) == plain(first + second)
    store.delete(docs(first).select("doc_id"))
    assert shown(store.apply(docs(second), True)) == plain(second)
    store.delete(docs(second).select("doc_id"))
    assert store.counts.count() == 0
    store.insert(docs(first))
    store.insert(docs(first))  # held already
    assert shown(store.apply(docs(first), True)) == plain(first)
    assert shown(store.apply(docs(first), True, filter_bytes=0)) == plain(first)


def test_store_counts_exactly_over_many_segments(spark, docs, corpus, edges, monkeypatch):
    monkeypatch.setattr(line_dedup, "SEGMENTS", 2)
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    rows = some(corpus, edges)
    key = lambda line: line_dedup.line_key(line.encode())
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, i))
    store, inside = line_dedup.LineStore(spark, shards=2), []
    for k in range(4):
        part = [r for r in rows if r[0] in set(ids[k::4])]
        store.insert(docs(part))
        inside += part
    store.delete(docs([(i, "") for i in ids[1::4]]).select("doc_id"))
    inside = [r for r in inside if r[0] not in set(ids[1::4])]
    held: dict = {}
    for i, t in inside:
        for line in (t or "").split("\n"):
            if key(line) is not None:
                held.setdefault(key(line), set()).add(line_dedup.NULL_ID if i is None else i)
    got = {struct.pack("<qq", r["k1"], r["k2"]): (r["n"], r["owner"], r["last"]) for r in store.counts.collect()}
    assert got == {k: (len(v), min(v), max(v)) for k, v in held.items()}
    assert store.shards > 2
    known = {r["shard"]: line_dedup.CuckooFilter(bytes(r["filter"])) for r in store.filters.collect()}
    for k, v in held.items():
        k1, k2 = (np.array([x]) for x in struct.unpack("<qq", k))
        if len(v) > 1:
            assert known[int(k1[0] % store.shards)].contains(k1, k2).all()
    assert shown(store.apply(docs(inside), True)) == plain(inside)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 50), st.integers(0, 2**32))
def test_cuckoo_filter(n, expected, seed):
    r = np.random.default_rng(seed)
    k1, k2 = (r.integers(-(2**63), 2**63 - 1, n) for _ in range(2))
    f = line_dedup.CuckooFilter(expected=expected)
    f.insert(k1, k2)
    f = line_dedup.CuckooFilter(f.to_bytes())
    assert f.contains(k1, k2).all()
    half = n // 2
    f.delete(k1[:half], k2[:half])
    assert f.contains(k1[half:], k2[half:]).all()
    assert n < 100 or f.contains(k1[:half], k2[:half]).mean() < 0.05
    f.delete(k1[half:], k2[half:])
    assert all((t == 0).all() for t in f.tables)


def test_text_form(spark, docs):
    rows = [(1, "one line that repeats\nown"), (2, "One line that repeats\nother"), (3, None)]
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["lang"]) for r in line_dedup.clean_text(docs(rows)).collect()}
    assert got == {1: (rows[0][1], 25, "en"), 2: ("other", 5, "en"), 3: (None, None, "en")}
    assert line_dedup.line_dedup(docs([])).count() == 0
