import duckdb
import numpy as np
import pytest

from kmerloom.config import Cleaning
from kmerloom.plans import catalog
from kmerloom.streaming import ingest

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_stream(spark, tmp_path):
    (tmp_path / "A.fa").write_text(">x\nACGU\n>unknown y\nACGU\n>z\nacgu\n>w\nGGGGG\n")
    stream = ingest.clean_stream(ingest.read_stream(spark, str(tmp_path)), Cleaning(min_len=4, max_len=10))
    q = stream.writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["sequence"] for r in spark.table("cleaned").collect()) == ["ACGU", "GGGGG"]


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_against_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, DIR)
    cur = db.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(tuple(r[columns.index(c)] for c in sorted(columns))) for r in cur.fetchall())
    assert sorted(repr(tuple(r[c] for c in sorted(columns))) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - {"rf_fit", "shap_top_features"}))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_corpus_operators(monkeypatch):
    """The pipeline's file may be there when the subpackage isn't."""
    import importlib.util

    import __spark_entry__ as entry
    from jobs import queries as jobs

    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith("kmerloom.llm") else real(name, *a))
    assert set(entry.queries()) == set(catalog.QUERIES) | set(jobs.QUERIES)
    assert set(entry.oracle_sql()) == set(catalog.ORACLES) | set(jobs.ORACLES)


def test_long_pairs_of_all_features(spark):
    got = {(r["f1"], r["f2"]): r["r"] for r in catalog.QUERIES["corr_pairs_long_all"](spark, DIR).collect()}
    x = np.array([r[0] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").select("embedding").collect()], float)
    want = np.corrcoef(x.T)
    assert set(got) == {(i, j) for i in range(64) for j in range(i + 1, 64)}
    assert all(abs(r - want[p]) < 1e-5 for p, r in got.items())
