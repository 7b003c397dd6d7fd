import time
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kmerloom.operators import blocks, correlation
from kmerloom.sources import fasta


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>").repartition(parts)


def as_dict(pairs):
    return {(r["f1"], r["f2"]): r["r"] for r in pairs.collect()}


def test_blocks_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(300, 37)) * np.arange(1, 38) + 1e4
    x[:, 9] = 3.5  # constant
    x[:, 20] = -x[:, 2]
    x[200:] = x[:100]  # repeated rows
    with np.errstate(invalid="ignore"):
        want = np.corrcoef(x.T)
    got = as_dict(blocks.pairs(table(spark, x), block=8, lot=37 * 8 * 23))
    assert set(got) == {(i, j) for i in range(37) for j in range(i + 1, 37) if 9 not in (i, j)}
    assert all(np.isclose(r, want[p], atol=1e-9) for p, r in got.items())
    strong = as_dict(blocks.pairs(table(spark, x), 0.1))
    assert set(strong) == {p for p, r in got.items() if abs(r) > 0.1} and np.isclose(strong[2, 20], -1)


def test_ranks_against_pandas(spark):
    x = np.random.default_rng(5).integers(0, 5, (200, 6)).astype(float)
    x[:, 1] = np.where(x[:, 1] < 4, 0.0, x[:, 1])  # one value holds most rows
    want = pd.DataFrame(x).rank().to_numpy()
    got = {r["id"]: r["features"] for r in blocks.ranked(table(spark, x), "id").collect()}
    assert len(got) == 200 and all(np.allclose(got[i], want[i]) for i in range(200))
    r = as_dict(blocks.pairs(blocks.ranked(table(spark, x), "id"), block=4))
    rho = pd.DataFrame(x).corr("spearman").to_numpy()
    assert len(r) == 15 and all(np.isclose(v, rho[p]) for p, v in r.items())


def test_odd_inputs(spark):
    x = np.ones((3, 2))
    assert blocks.pairs(table(spark, x).limit(0)).count() == 0 and blocks.pairs(table(spark, x)).count() == 0
    assert blocks.pairs(table(spark, x[:1])).count() == 0
    with pytest.raises(ValueError, match="missing"):
        blocks.pairs(table(spark, np.array([[1, np.nan], [2, 3]])))
    with pytest.raises(ValueError, match="lengths"):
        blocks.pairs(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, features array<double>"))


def plain_linkage(r):
    """Average linkage by looking at all pairs of clusters at every step."""
    d, members, out = 1 - np.abs(r), {i: [i] for i in range(len(r))}, []
    for step in range(len(r) - 1):
        h, x, y = min((d[np.ix_(members[a], members[b])].mean(), a, b) for a in members for b in members if a < b)
        members[len(r) + step] = members.pop(x) + members.pop(y)
        out.append((step, x, y, h))
    return out


def test_chain_of_nearest_neighbours():
    for seed, n in ((1, 2), (2, 3), (3, 25), (4, 40)):
        r = np.corrcoef(np.random.default_rng(seed).normal(size=(n, 12)))
        got, want = correlation.dendrogram(r), plain_linkage(r)
        assert [m[:3] for m in got] == [m[:3] for m in want] and np.allclose([m[3] for m in got], [m[3] for m in want])
    equal = correlation.dendrogram(np.ones((6, 6)))
    assert len(equal) == 5 and sorted(correlation.leaf_order(equal, 6)) == list(range(6)) and all(abs(m[3]) < 1e-12 for m in equal)
    assert correlation.dendrogram(np.ones((1, 1))) == []


def test_many_features_are_clustered_in_time():
    x = np.random.default_rng(6).normal(size=(60, 4096))
    r, t = np.corrcoef(x.T), time.time()
    merges = correlation.dendrogram(r)
    assert time.time() - t < 60 and len(merges) == 4095
    assert all(a[3] <= b[3] for a, b in zip(merges, merges[1:], strict=False))


def test_a_file_is_seen_once_it_is_whole(spark, tmp_path):
    records = spark.range(4000).select(F.lit("one").alias("genus"), F.col("id").alias("seq_idx"), F.col("id").cast("string").alias("header"), F.lit("ACGU").alias("sequence"))
    broken = records.withColumn("header", F.when(F.col("seq_idx") != 3000, F.col("header")))  # found while the file is written
    with pytest.raises(Exception, match="NoneType"):
        fasta.write_files(broken, str(tmp_path)).collect()
    assert not [f for f in Path(tmp_path).iterdir() if not f.name.startswith(".")]
    for _ in range(2):  # written anew
        assert [tuple(r) for r in fasta.write_files(records, str(tmp_path)).collect()] == [("one", "one.clean.fa", 4000)]
    assert fasta.read_folder(spark, str(tmp_path)).count() == 4000
