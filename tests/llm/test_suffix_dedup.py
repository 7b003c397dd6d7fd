import hashlib
import random
from collections import Counter

from kmerloom.llm import suffix_dedup


def plain(rows):
    starts = Counter(b[k : k + 200] for _, t in rows for b in [(t or "").encode()] for k in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if starts[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i or 0, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def some(corpus, edges):
    r = random.Random(0)
    base = corpus[6][1]
    rows = corpus[:80] + edges
    for i in range(40):
        a, n = r.randint(0, 1500), r.choice([199, 200, 201, 250, 400, 700])
        rows.append((10_000 + i, "".join(r.choices("abcdefgh é", k=r.randint(0, 300))) + base[a : a + n] + "".join(r.choices("xyz", k=r.randint(0, 300)))))
    return rows + [(20_003, "a" * 1000), (20_004, "a" * 199), (20_005, "a" * 200), (20_006, "ab" * 300 + "q"), (20_007, "z" * 200), (20_009, "b" * 200), (20_010, "é" * 100), (20_011, "xé" * 66 + "é"), (20_012, "z" * 201), (20_013, "q" * 300), (20_013, "r" * 300)]


def test_against_plain(spark, docs, corpus, edges):
    rows = some(corpus, edges)
    got = suffix_dedup.remove_repeats(docs(rows), digests=True).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain(rows)


def test_many_partitions(spark, docs, corpus, edges):
    """Buckets that run over the edges of tasks."""
    rows = [(i, corpus[6][1][:400]) for i in range(30)] + [(100 + i, f"{i} " * 40 + corpus[6][1][50:300]) for i in range(30)]
    n = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        got = suffix_dedup.remove_repeats(docs(rows), digests=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", n)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == plain(rows)


def test_bytes_and_empty(spark, docs):
    text = "".join(random.Random(1).choices("abcdef ", k=250))
    r = {x["doc_id"]: x for x in suffix_dedup.remove_repeats(docs([(1, text + "tail"), (2, "head" + text)])).collect()}
    assert bytes(r[1]["kept"]) == b"tail" and bytes(r[2]["kept"]) == b"head"
    assert [(s["start"], s["end"]) for s in r[2]["spans"]] == [(4, 254)]
    assert suffix_dedup.remove_repeats(docs([])).count() == 0
