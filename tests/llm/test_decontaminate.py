import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import decontaminate


def plain(text, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, ids = cut(text), set(), set()
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            window = w[k : k + size]
            for j in range(len(own) - len(window) + 1):
                if own[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    ids.add(i)
    return len(own), len(hit), sorted(ids)


def test_against_plain(spark, docs, corpus, edges):
    passage = corpus[0][1].split()
    items = [("1", " ".join(passage[5:30])), ("10", "Short ITEM, here"), ("2", None), ("3", ""), ("4", " ".join(passage[20:32])), ("5", " ".join(passage[5:30]))]
    rows = corpus[:40] + edges + [(7004, ("filler " * 700 + " ".join(passage[5:17]) + " x ") * 3)] + [(7001, "a short-item: HERE short item here"), (7002, " ".join(passage[5:14])), (7003, "é " + " ".join(passage[8:18]) + " – " + " ".join(passage[6:16]))]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id string, text string, doc_id string")
    order = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(((i, *plain(t, items)) for i, t in rows), key=order)
    for part_bytes in (1 << 20, 60):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["item_ids"])) for r in decontaminate.decontaminate(docs(rows), bench, part_bytes=part_bytes).collect()), key=order)
        assert got == want
    clean = sorted(((r["doc_id"],) for r in decontaminate.drop_contaminated(docs(rows), bench, part_bytes=60).collect()), key=order)
    assert clean == [(w[0],) for w in want if not w[2]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=6), st.lists(st.lists(st.sampled_from("abcd"), max_size=40), min_size=1, max_size=4))
def test_automaton(items, many):
    """Few words, so that patterns overlap and end within each other."""
    named = [(str(k % 4), " ".join(w)) for k, w in enumerate(items)]
    built = decontaminate.build(named, 4)
    cut = [[x.encode() for x in w] for w in many]
    got = decontaminate.Automaton(built, 4).scan(cut) if built else [([], set())] * len(cut)
    for (ranges, ids), w in zip(got, many, strict=True):
        assert (len(w), sum(z - a + 1 for a, z in ranges), sorted(ids)) == plain(" ".join(w), named, 4)


def test_automaton_is_small():
    r = random.Random(2)
    items = [(str(k), " ".join(f"w{r.randrange(20_000)}" for _ in range(100))) for k in range(1500)]
    assert len(decontaminate.build(items)) < 33 * sum(len(t) for _, t in items)  # 16 MB of items: about 500 MB


def test_spans_are_of_the_original(spark, docs):
    text = "Éa! The QUICK brown–fox, jumps"
    bench = spark.createDataFrame([(1, "quick Brown")], "item_id long, text string")
    r = decontaminate.decontaminate(docs([(1, text)]), bench).first()
    assert r["n_hit"] == 0  # the dash is a word's letter, as every letter beyond ASCII
    r = decontaminate.decontaminate(docs([(1, text.replace("–", "-"))]), bench).first()
    assert [text.replace("–", "-")[s["start"] : s["end"]] for s in r["spans"]] == ["QUICK brown"]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs([(1, "a b")]), none).first()["n_hit"] == 0
    assert decontaminate.decontaminate(docs([]), none).count() == 0
