import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import runs


def plain(words, least=6, times=4):
    """All runs by trying every period at every place."""
    n, out = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q) and j > i:
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in out.items())


def row(i, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(i).encode())
    if i is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    found = sorted(plain(w), key=lambda r: (r[0], r[2]))
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-(r[1] / r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def of_batch(many, least, times):
    sizes = np.array([len(m) for m in many], np.int64)
    numbers = np.array([x for m in many for x in m], np.int64)
    return runs.runs(numbers, sizes, least, times)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (4, 3)]))
def test_all_runs(many, how):
    found = of_batch(many, *how)
    for t, m in enumerate(many):
        assert sorted(found.get(t, [])) == plain(m, *how)


def test_long_periodic_texts():
    """Powers of words, Fibonacci words, a period of many words with runs inside, copies of it, and one long run."""
    rng = random.Random(3)
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    block = [rng.randrange(5) for _ in range(40)] + [7] * 9 + [8, 9] * 6 + [1, 2, 3]
    many = [fib[-1], block * 6, [5] * 500, [1, 2] * 300 + [3] + [1, 2] * 300, list(range(50)) + block + [4] + block + list(range(9)) + block, [], [1], [0, 0, 1] * 90 + [0] * 20 + [0, 0, 1] * 90, sum(([k] * 8 for k in range(60)), []) + list(range(60)) * 5]
    for how in ((6, 4), (2, 2)):
        found = of_batch(many, *how)
        for t, m in enumerate(many):
            assert sorted(found.get(t, [])) == plain(m, *how)


def test_open_ends_are_walked(monkeypatch):
    monkeypatch.setattr(runs, "ROUNDS", 1)
    rng = random.Random(5)
    many = [[rng.randrange(2) for _ in range(300)], [0] * 100 + [1] + [0] * 99, list(range(30)) * 5]
    found = of_batch(many, 2, 2)
    for t, m in enumerate(many):
        assert sorted(found.get(t, [])) == plain(m, 2, 2)


def test_against_plain(docs, corpus, edges):
    rng = random.Random(1)
    built = [(10_000 + i, " ".join(rng.choice("ab") if rng.random() < 0.5 else "x" * rng.randrange(1, 3) for _ in range(rng.randrange(120)))) for i in range(60)]
    rows = [(i, t) for i, t in corpus if len(t or "") < 6000] + built + edges + [(7, "la la la la la la la la la la la la"), (8, "\x1cfoo \x85bar " * 9)]
    got = sorted((tuple(r) for r in runs.digests(docs(rows)).collect()), key=repr)
    want = [(i, t) for i, t in rows if len(t or "") < 100_000]
    assert [g for g in got if g[0] != 900_006] == sorted((row(i, t) for i, t in want), key=repr)
    long = next(g for g in got if g[0] == 900_006)
    assert long[1] >= 1 and long[4] == 1  # one word, forty thousand times


def test_general_interface(docs):
    got = {r["doc_id"]: r for r in runs.find_runs(docs([(1, "so so so so so so it\tgoes \n on"), (2, None)])).collect()}
    assert got[1]["collapsed"] == "so it goes on" and [tuple(x) for x in got[1]["runs"]] == [(0, 6, 1)]
    assert (got[2]["n_words"], got[2]["runs"], got[2]["collapsed"]) == (0, [], "")
    assert runs.digests(docs([])).count() == 0
