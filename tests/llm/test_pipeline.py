import hashlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from kmerloom.llm import quality
from kmerloom.llm.queries import QUERIES, tokenizer_path

from .test_decontaminate import plain as hits
from .test_line_dedup import LOWER
from .test_near_dedup import plain as groups

DIR = "/root/testdata/sf0.001"


def test_run_against_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    good = []
    for i, t in rows:
        s, f = quality.statistics(t)
        if not quality.base_fails(s[0], s[4]) and (trees is None or trees.probability(np.array([f]))[0] >= quality.KEEP):
            good.append((i, t))
    key = lambda line: line.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    owner: dict = {}
    for i, t in good:
        for line in t.split("\n"):
            owner.setdefault(key(line), i)
    lines = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or owner[key(x)] == i)) for i, t in good]
    kept = groups(lines)
    unique = [(i, t) for i, t in lines if kept[i][2]]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in _windows(t)}
    clean = [(i, t) for i, t in unique if not (windows & _windows(t)) or not hits(t, items)[1]]
    library = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), ids))
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["ids"]) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == want and 0 < len(got) < len(rows)


def _windows(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    return {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}


def test_stages_keep_columns(spark, docs, edges):
    rows = docs(edges + [(1, " ".join(f"w{i}" for i in range(60)))])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, rows, DIR).schema.fieldNames() == rows.schema.fieldNames()
        stage(spark, rows, DIR).collect()
    empty = rows.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DIR).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13))
