import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from kmerloom.llm import bpe
from kmerloom.llm.queries import tokenizer_path

LETTERS = ["a", "b", " ", "\n", "\t", "é", "ß", "'s", "'re", "'LL", "<|endoftext|>", "1", "٣", "²", " ", "\x1c", "\x85", "　", "漢", "😀", "​", "Ⅷ", "́", "!!", "aaaa", "$$$", "the", "\x00", "_"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokenizer_path(), encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def fuzz(n=1500):
    r = random.Random(1)
    return ["".join(r.choices(LETTERS, k=r.randint(0, 60))) for _ in range(n)] + ["a" * 5000, " " * 3000, "ab" * 4000, "", "x" * 49]


def test_ids_and_round_trip(library, vocabulary, corpus):
    texts = fuzz() + [t for _, t in corpus]
    words = list({w.encode() for t in texts for w in bpe.PRETOKEN.findall(t)})[::3]
    lexicon = bpe.compile_lexicon(dict(zip(words, vocabulary.merge(words), strict=True)))
    for encoder in (bpe.Encoder(vocabulary, lexicon), bpe.Encoder(vocabulary)):
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want
            assert encoder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_decoding_of_any_ids(library, vocabulary):
    r = random.Random(2)
    encoder = bpe.Encoder(vocabulary)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(8)]
        assert encoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_automaton_is_minimal_and_exact():
    words = {w: np.array([i, i + 1][: 1 + i % 2], "<u4").tobytes() for i, w in enumerate(sorted(a + b + c for a in (b"x", b"y", b"zz") for b in (b"", b"in", b"out") for c in (b"s", b"ing", b"ed")))}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(words))
    asked = [*words, b"", b"x", b"xi", b"xinge", b"q", b"zzouting"]
    assert lexicon.find(asked) == [words.get(w) for w in asked]
    assert len(lexicon.final) < 20  # shared prefixes and suffixes
    assert bpe.Lexicon(bpe.compile_lexicon({})).find([b"a"]) == [None]


def test_operator(spark, docs, edges, library):
    rows = edges + [(1, "Some text, some text.")]
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(docs(rows), tokenizer_path(), words=5).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((i or 0, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    assert got == sorted(want)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(rows[-1:]), tokenizer_path()), tokenizer_path()).collect()}
    assert back == {1: "Some text, some text."}
    assert bpe.digests(docs([]), tokenizer_path()).count() == 0
