import math
import zlib
from collections import Counter

import numpy as np

from kmerloom.llm import lm

SMALL = lm.Shape(4, 6, 8, 24)


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def words(t):
    return (t or "").encode().lower().split() + [b""]


def test_base_and_counts(spark, docs, corpus, edges):
    rows = corpus + edges
    got = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lm.score_documents(docs(rows), SMALL, 300).collect())
    c = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    total, distinct = sum(c.values()), len(c)
    want = [(i or 0, held_out(i), len(words(t)), sum(w in c for w in words(t)), total, round(sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in words(t)), 6)) for i, t in rows]
    assert got == sorted(want)


def plain_scores(m, rows, counts):
    """Word by word: softmax over units, softmax within the class, add-one share within the cell."""
    sh, t = m.shape, m.tables
    own = {b"": 0, **{w: i for i, w in enumerate(m.frequent, 1)}}
    output = lambda w: own.get(w, sh.own + zlib.crc32(w) % sh.cells)
    cells: dict = {}
    for w, n in counts.items():
        if w not in own:
            x = cells.setdefault(output(w), [0, 0])
            x[0] += n
            x[1] += 1
    softmax = lambda s: np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    out = []
    for i, text in rows:
        before, score = [sh.outputs, sh.outputs], 0.0
        for w in words(text):
            o = output(w)
            h = (t.first[before[-1]] + t.second[before[-2]]).astype(float)
            units = softmax(t.out.astype(float) @ h + t.bias)
            if o < sh.head:
                p = units[o]
            else:
                k, j = (o - sh.head) % sh.classes, (o - sh.head) // sh.classes
                of = slice(k * sh.members, (k + 1) * sh.members)
                p = units[sh.head + k] * softmax(t.member[of].astype(float) @ h + t.member_bias[of])[j]
            if o >= sh.own:
                p *= (counts.get(w, 0) + 1) / (sum(cells.get(o, (0, 0))) + 1)
            score += math.log10(p)
            before.append(o)
        out.append((i or 0, round(score, 3)))
    return sorted(out)


def test_scores_against_plain(spark, docs, corpus, edges):
    rows = corpus[:60] + [e for e in edges if e[0] != 900_006] + [(900_006, "long " * 3000)]
    counts = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    m = lm.fit(docs(rows), SMALL, 100)
    got = sorted((r["doc_id"] or 0, r["score"]) for r in lm.scores(m).collect())
    want = plain_scores(m, rows, counts)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-4, atol=0.01)


def test_probabilities_sum_to_one():
    r = np.random.default_rng(0)
    t = lm.Tables.start(r.integers(1, 100, SMALL.outputs).astype(float), SMALL)
    s = lm.Scorer(t, SMALL)
    w = np.arange(SMALL.outputs)
    for c1, c2 in ((0, 3), (SMALL.outputs, SMALL.outputs), (5, SMALL.outputs)):
        assert np.isclose(np.exp(s.log_probability(w, np.full(len(w), c1), np.full(len(w), c2))).sum(), 1, atol=1e-5)
    back = lm.Tables.of(t.rows(), SMALL)
    assert all((getattr(t, n) == getattr(back, n)).all() for n in ("first", "second", "out", "bias", "member", "member_bias"))


def test_layout_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    shown = lambda d: {r["doc_id"]: r["score"] for r in lm.score_documents(d).collect()}
    one, many = shown(docs.coalesce(1)), shown(docs.orderBy("n_chars").repartition(7))
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-6) for i in one)  # products of other blocks round otherwise


def test_model_beats_base_on_held_out_texts(spark):
    scored = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    s = scored.agg({"score": "sum", "base_score": "sum"}).first()
    assert s["sum(score)"] > s["sum(base_score)"]


def test_training_lowers_the_loss():
    r = np.random.default_rng(1)
    w = np.zeros(40_000, np.uint16)
    for i in range(1, len(w)):  # each word is mostly followed by the next one
        w[i] = (w[i - 1] + 1) % 20 if r.random() < 0.9 else r.integers(20)
    counts = np.bincount(w, minlength=SMALL.outputs).astype(float)
    trainer = lm.Trainer(lm.Tables.start(counts, SMALL), counts, SMALL, 0)
    c1, c2 = np.roll(w, 1), np.roll(w, 2)
    before = lm.Scorer(lm.Tables.start(counts, SMALL), SMALL).log_probability(w, c1, c2).mean()
    for _ in range(20):
        trainer.chunk(w, c1, c2)
    assert lm.Scorer(trainer.t, SMALL).log_probability(w, c1, c2).mean() > before + 0.7


def test_contexts_stop_at_texts():
    v = lm.Vocabulary([b"a", b"b"], [b"k"], SMALL)
    w, n, ids, flat = v.encode([[b"a", b"z"], [], [b"b", b"k"]])
    z, k = SMALL.cell(b"z"), SMALL.cell(b"k")
    assert w.tolist() == [1, z, 0, 0, 2, k, 0] and n.tolist() == [3, 1, 3] and ids.tolist() == [1, ~z, 0, 0, 2, 3, 0] and flat[1] == b"z"
    c1, c2 = lm.contexts(w, n, SMALL)
    e = SMALL.outputs
    assert c1.tolist() == [e, 1, z, e, e, 2, k] and c2.tolist() == [e, e, 1, e, e, e, 2]


def test_empty_and_untrained(spark, docs):
    assert lm.score_documents(docs([])).count() == 0
    only = next(i for i in range(100) if held_out(i))
    r = lm.score_documents(docs([(only, "some words")])).first()
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0)


def test_the_end_is_known_among_few_long_texts(spark, docs):
    """Eight texts of 150 words that are all more frequent than the texts' ends."""
    rows = [(i, " ".join(f"w{(i + k) % 5}" for k in range(150))) for i in range(8)]
    train = [t.split() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t) + Counter({"": len(train)})
    total, distinct = sum(counts.values()), len(counts)
    for known_words in (3, 100_000):
        for r in lm.score_documents(docs(rows), known_words=known_words).collect():
            own = rows[r["doc_id"]][1].split() + [""]
            assert r["n_known"] == r["n_tokens"] == 151
            assert np.isclose(r["base_score"], sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in own))
