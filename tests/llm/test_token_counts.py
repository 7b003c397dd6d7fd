import numpy as np
from tokenizers import Tokenizer

from kmerloom.llm import token_counts
from kmerloom.llm.queries import tokenizer_path


def plain(library, text):
    """Every token to the line with most of its characters, the earlier one on a tie, by looking at each character."""
    lines = text.split("\n")
    of = [i for i, line in enumerate(lines) for _ in range(len(line) + 1)][: len(text)]
    n = len(lines) - (len(lines) > 1 and lines[-1] == "")
    counts = [0] * n
    e = library.encode(text, add_special_tokens=False)
    for a, z in e.offsets:
        own = of[a:z]
        counts[max(sorted(set(own)), key=lambda s: (own.count(s), -s))] += 1
    return counts


def test_against_characters(spark, docs, corpus, edges):
    library = Tokenizer.from_file(tokenizer_path())
    library.post_processor = None  # whole offsets, white space included
    rows = [r for r in corpus[:60] + edges + [(5_000, "a\n\n\nb\r\n\r\n  c\n"), (5_001, "\n"), (5_002, "!\n!\n")] if r[0] is not None and r[0] != 900_004]
    got: dict = {}
    for r in token_counts.token_counts(docs(rows), tokenizer_path()).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["start"], r["end"], r["n_tokens"], r["doc_tokens"]))
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        text, own = t or "", sorted(got[i])
        assert own[0][1] == 0 and own[-1][2] == len(text) and all(x[2] == y[1] for x, y in zip(own, own[1:], strict=False))
        assert sum(x[3] for x in own) == own[0][4] == len(library.encode(text, add_special_tokens=False).ids)
        assert [text[x[1] : x[2]] for x in own] == (text.splitlines(keepends=True) if "\n" not in text else [*(s + "\n" for s in text.split("\n")[:-1]), *([text.rpartition("\n")[2]] if not text.endswith("\n") else [])]) or not text
        if text and len(text) < 20_000:
            assert [x[3] for x in own] == plain(library, text)


def test_crossing_rule():
    tokens, crossing = token_counts.attribute(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 10]), np.array([4, 6, 10]))
    assert tokens.tolist() == [2, 0, 2] and crossing.tolist() == [1, 0, 1]  # 3-5 ties, so the earlier; 5-9 lies mostly in the last


def test_empty(spark, docs):
    assert token_counts.token_counts(docs([]), tokenizer_path()).count() == 0
