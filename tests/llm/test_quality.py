import re
from collections import Counter

import numpy as np

from kmerloom.llm import quality


def plain(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, repeated = len(words), len(hit)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, repeated, n < 50 or 100 * repeated > 50 * n


def test_statistics(spark, docs, corpus, edges):
    rows = corpus + edges + [(1_000, "a b c a b c"), (1_001, "a a a a"), (1_002, "x\ny\nx\n \n \nx"), (1_003, "a b c")]
    got = sorted((r["doc_id"] or 0, *(r[s] for s in quality.STATS), r["base_failed"], r["kept"]) for r in quality.judge(docs(rows), None).collect())
    assert got == sorted((i or 0, *plain(t), not plain(t)[-1]) for i, t in rows)


def test_trees_and_monotonicity():
    r = np.random.default_rng(0)
    x = r.random((3000, len(quality.FEATURES)))
    j = quality.FEATURES.index("symbol_rate")
    y = (x[:, j] + 0.3 * x[:, 0] + 0.2 * r.normal(size=3000) < 0.6).astype(float)
    y[x[:, j] > 0.9] = 1  # data that speak against the constraint
    trees = quality.fit(x, y)
    agree = x[:, j] <= 0.9
    assert ((trees.probability(x) > 0.5) == y)[agree].mean() > 0.8
    probe = np.repeat(x[:50], 30, 0)
    probe[:, j] = np.tile(np.linspace(0, 1, 30), 50)
    assert (np.diff(trees.probability(probe).reshape(50, 30), axis=1) <= 1e-12).all()
    free = quality.fit(x, y, {}).probability(probe).reshape(50, 30)
    assert (np.diff(free, axis=1) > 1e-6).any()
    assert quality.fit(x, np.ones(3000)) is None


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    even = labels.filter("doc_id % 2 = 0")
    judged = quality.judge(docs.join(labels.filter("doc_id % 2 = 1").select("doc_id"), "doc_id", "left_semi"), quality.train(docs, even))
    rows = judged.join(labels, "doc_id").select("base_failed", "probability", "quality").collect()
    right = np.mean([(r["probability"] >= 0.5) == (r["quality"] > 0) for r in rows])
    assert right > 0.98


def test_without_labels(spark, docs):
    none = spark.createDataFrame([(None, 1), (5, None)], "doc_id long, quality int")
    rows = [(1, "word " * 10), (2, " ".join(f"w{i}" for i in range(60)))]
    assert {r["doc_id"]: r["kept"] for r in quality.quality_rules(docs(rows), none).collect()} == {1: False, 2: True}
    assert [r["doc_id"] for r in quality.keep_good(docs(rows), none).collect()] == [2]
    assert quality.quality_rules(docs([]), none).count() == 0
