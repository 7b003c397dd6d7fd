import random

import numpy as np

from kmerloom.llm import components, near_dedup


def plain(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i in sorted(sets):
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for a, b in {(h[x], h[y]) for h in holders.values() for x in range(len(h)) for y in range(x + 1, len(h))}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_against_plain(spark, docs, corpus, edges):
    r = random.Random(0)
    base = corpus[6][1].split()[:300]
    rows = corpus + [e for e in edges if e[0] is not None]
    for i in range(60):  # a chain of ever more distant copies
        w = list(base)
        for k in range(i // 2):
            w[(k * 7) % len(w)] = f"x{k}"
        rows.append((10_000 + i, " ".join(w)))
    for i in range(50):  # many that share a passage, most of them below the threshold
        rows.append((20_000 + i, " ".join(base[:120] + [f"y{r.randrange(60)}" for _ in range(25 + i % 10)])))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_dedup.near_duplicates(docs(rows)).collect()}
    assert got == plain(rows)
    stay = {x["doc_id"] for x in near_dedup.one_of_each(docs(rows)).collect()}
    assert stay == {i for i, w in got.items() if w[2]}


def test_null_ids_and_repeats(spark, docs):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, None), (4, "A  B c d E f g")]
    got = sorted((x["doc_id"] or 0, x["component_id"] or 0, x["kept"]) for x in near_dedup.near_duplicates(docs(rows)).collect())
    assert got == [(0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True), (4, 3, False)]
    assert near_dedup.near_duplicates(docs([])).count() == 0


def test_an_id_with_several_texts(spark, docs):
    """Links are of texts, whichever ids have them."""
    a = [f"w{i}" for i in range(100)]
    b = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(["x", *a[1:], "y"])), (3, " ".join([*b, "z"])), (4, "one two three"), (3, "something else that no other text of all these says"), ((1 << 63) - 1, "the largest id there is"), (None, "the largest id there is")]
    got = sorted(((x["doc_id"] or 0, x["n_shingles"], x["component_id"] or 0, x["kept"]) for x in near_dedup.near_duplicates(docs(rows)).collect()))
    top = (1 << 63) - 1
    assert got == [(0, 1, top, False), (1, 96, 1, True), (1, 96, 1, True), (2, 97, 1, False), (3, 6, 3, True), (3, 97, 1, False), (4, 1, 4, True), (top, 1, top, True)]
    assert sorted((x["doc_id"], x["text"][:9]) for x in near_dedup.one_of_each(docs(rows)).collect()) == [(1, "v0 v1 v2 "), (1, "w0 w1 w2 "), (3, "something"), (4, "one two t"), (top, "the large")]


def test_registers():
    r = np.random.default_rng(0)
    a, b = (np.unique(r.integers(0, 2**63, 500).astype(np.uint64)) for _ in range(2))
    both = np.union1d(a, b)
    assert (np.maximum(near_dedup.registers(a), near_dedup.registers(b)) == near_dedup.registers(both)).all()
    for j in (0.5, 0.75, 0.9):
        n, common = 800, round(2 * 800 * j / (1 + j))
        found = []
        for _ in range(40):
            x = r.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            found.append(near_dedup.estimate(near_dedup.registers(x[:n])[None], near_dedup.registers(x[n - common :])[None], np.array([n]), np.array([n]))[0])
        assert abs(np.mean(found) - j) < 0.03 and np.std(found) < 0.07


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)]
    parent = {n: n for e in edges for n in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0
