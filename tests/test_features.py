import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.config import Kmers, Splitting
from kmerloom.functions import sequences
from kmerloom.operators import correlation, embed, kmers, split, stats


def seqs(spark, rows):
    return spark.createDataFrame(rows, "sequence_id string, sequence string")


def test_kmers(spark):
    df = seqs(spark, [("a", "AAAA"), ("b", "ACNGU"), ("c", "acgu"), ("d", "A"), ("e", "NNNN")])
    f = {(r["sequence_id"], r["kmer"]): r["freq"] for r in kmers.frequencies(df, p=Kmers(2)).collect()}
    assert f == {("a", "AA"): 1.0, ("b", "AC"): 0.5, ("b", "GU"): 0.5, ("c", "AC"): 1 / 3, ("c", "CG"): 1 / 3, ("c", "GU"): 1 / 3}
    assert sorted(r[0] for r in kmers.without_kmers(df, Kmers(2)).select("sequence_id").collect()) == ["d", "e"]
    m = {r["sequence_id"]: r["features"] for r in kmers.matrix(df, p=Kmers(2)).collect()}
    names = [r["kmer"] for r in kmers.vocabulary(spark, Kmers(2)).orderBy("kmer_idx").collect()]
    assert names[:5] == ["AA", "AC", "AG", "AU", "CA"] and set(m) == {"a", "b", "c"}
    assert {(i, names[j]): x for i, row in m.items() for j, x in enumerate(row) if x} == f


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGUN", max_size=30), min_size=1, max_size=8))
def test_kmer_counts_property(spark, texts):
    df = seqs(spark, [(str(i), t) for i, t in enumerate(texts)])
    got = {r["sequence_id"]: r["n"] for r in kmers.counts(df, p=Kmers(3)).groupBy("sequence_id").agg(F.sum("n").alias("n")).collect()}
    want = {str(i): n for i, t in enumerate(texts) if (n := sum("N" not in t[j : j + 3] for j in range(len(t) - 2)))}
    assert got == want
    back = df.select("sequence_id", sequences.reverse_complement(sequences.reverse_complement(F.translate("sequence", "N", "A"))).alias("s"))
    assert {r[0]: r[1] for r in back.collect()} == {str(i): t.replace("N", "A") for i, t in enumerate(texts)}


def manifest_rows(spark, groups, per=3):
    return spark.createDataFrame([(f"s{g}_{i}", f"acc{g}", "XY"[g % 2]) for g in range(groups) for i in range(per)], "sequence_id string, accession string, genus string")


def test_group_split(spark):
    rows = manifest_rows(spark, 10)
    m = split.manifest(rows)
    sizes = {r["split"]: r["groups"] for r in split.sizes(m).collect()}
    assert sizes == {"test": 2, "val": 2, "train": 6}
    assert split.leaks(m).isEmpty() and m.count() == 30
    shuffled = split.manifest(rows.orderBy(F.rand(1)))
    assert sorted(map(tuple, m.collect())) == sorted(map(tuple, shuffled.collect()))
    with pytest.raises(ValueError, match="too few"):
        split.group_split(manifest_rows(spark, 1))


@pytest.mark.parametrize(("test", "val"), [(0, 0.2), (1.0, 0.2), (0.2, 0.8), (0.2, 0)])
def test_fractions(spark, test, val):
    with pytest.raises(ValueError, match="fraction"):
        split.group_split(manifest_rows(spark, 10), p=Splitting(test=test, val=val))


def test_check_split(spark):
    base = split.manifest(manifest_rows(spark, 10))
    assert split.check_split(base).count() == 30
    with pytest.raises(ValueError, match="unknown split"):
        split.check_split(base.withColumn("split", F.lit("dev")))
    leaky = base.withColumn("split", F.when(F.col("sequence_id").endswith("_0"), "train").otherwise("test"))
    with pytest.raises(ValueError, match="several splits"):
        split.check_split(leaky)
    one = base.withColumn("split", F.when(F.col("genus") == "X", "train").otherwise("test"))
    with pytest.warns(UserWarning, match="has no rows"):
        split.check_split(one)


def test_folds(spark):
    rows = manifest_rows(spark, 10)
    folds = split.group_folds(rows, folds=5)
    assert {r["fold"] for r in folds.collect()} == set(range(5)) and folds.count() == 10
    with pytest.warns(UserWarning, match="folds instead"):
        assert split.group_folds(manifest_rows(spark, 4), folds=5).select("fold").distinct().count() == 2
    with pytest.warns(UserWarning):
        assert split.group_folds(manifest_rows(spark, 2), folds=5) is None


def test_folds_of_many_groups(spark):
    many = spark.range(1_000_000).select(F.col("id").alias("accession"), F.lit("a").alias("genus"))
    large = spark.range(500_000).select(F.lit(-1).cast("long").alias("accession"), F.lit("a").alias("genus"))
    rare = spark.createDataFrame([(-2 - i // 3, "b") for i in range(6)], "accession long, genus string")
    rows = many.unionByName(large).unionByName(rare)
    with pytest.warns(UserWarning, match="folds instead"):
        folds = split.group_folds(rows).cache()
    assert folds.count() == folds.select("accession").distinct().count() == 1_000_003
    n = {(r["genus"], r["fold"]): r["n"] for r in rows.join(folds, "accession").groupBy("genus", "fold").agg(F.count("*").alias("n")).collect()}
    assert n["b", 0] == n["b", 1] == 3 and abs(n["a", 0] - n["a", 1]) < 1500
    folds.unpersist()


def feature_rows(spark, x, **columns):
    return spark.createDataFrame([(i, [float(v) for v in r], *(c[i] for c in columns.values())) for i, r in enumerate(x)], "vec_id long, features array<double>" + "".join(f", {n} string" for n in columns))


def test_statistics_and_sparse_form(spark):
    x = np.array([[0, 1, 5], [0, 1, 0], [2, 1, -1], [0, 1, 3.0]])
    s = {r["idx"]: r for r in stats.feature_statistics(feature_rows(spark, x)).collect()}
    for j in range(3):
        assert np.isclose(s[j]["mean"], x[:, j].mean()) and np.isclose(s[j]["variance"], x[:, j].var(ddof=1)) and s[j]["fraction_zero"] == (x[:, j] == 0).mean()
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(4) for j in range(3) if x[i, j]], "sequence_id long, kmer_idx long, freq double")
    t = {r["idx"]: r for r in stats.sparse_statistics(long, 4).collect()}
    for j in range(3):
        assert np.isclose(t[j]["variance"], s[j]["variance"]) and t[j]["minimum"] == s[j]["minimum"] and t[j]["maximum"] == s[j]["maximum"]
    assert [r["idx"] for r in stats.constant_features(stats.feature_statistics(feature_rows(spark, x))).collect()] == [1]


def test_twins_in_different_splits(spark):
    rows = feature_rows(spark, [[1, 2], [1, 2], [3, 4]], split=["train", "test", "train"])
    assert [r["vec_id"] for r in stats.duplicate_features(rows, "vec_id").collect()] == [1]


def test_missing_values_and_imbalance(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, "b")], "x double, genus string")
    assert {r["column_name"]: r["missing"] for r in stats.missing_values(df).collect()} == {"x": 2, "genus": 1}
    many = spark.createDataFrame([("a",)] * 11 + [("b",)], "genus string")
    assert stats.imbalance(many).first()["verdict"] == "high"


def reduction_rows(spark):
    r = np.random.default_rng(0)
    f1, f6 = r.normal(size=20), r.normal(size=20)
    train = np.arange(20) < 14
    f4 = np.where(train, 1.0, np.arange(20))
    x = np.stack([f1, 2 * f1, -f1, f4, np.full(20, 7.0), f6], 1)
    return x, feature_rows(spark, x, split=["train" if t else "test" for t in train])


def test_reduction(spark):
    x, rows = reduction_rows(spark)
    reduced, kept, log = correlation.reduce_features(rows)
    assert len(kept) == 2 and 5 in kept and set(kept) & {0, 1, 2} and len(log) == 2
    got = {r["vec_id"]: r["features"] for r in reduced.collect()}
    assert np.allclose([got[i] for i in range(20)], x[:, kept])
    other = rows.withColumn("features", F.when(F.col("split") == "test", F.transform("features", lambda v: v * 3 + 1)).otherwise(F.col("features")))
    assert correlation.reduce_features(other)[1] == kept


def test_greedy_ties_and_property():
    r = np.array([[1, 0.99, 0], [0.99, 1, 0], [0, 0, 1.0]])
    assert correlation.greedy_drop(r, 0.95) == [(0, 1, 0.99)]
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 3))
    x = np.concatenate([base + 0.1 * rng.normal(size=base.shape) for _ in range(5)], 1)
    r = np.corrcoef(x.T)
    gone = {d for d, _, _ in correlation.greedy_drop(r, 0.9)}
    kept = [i for i in range(15) if i not in gone]
    left = np.abs(r[np.ix_(kept, kept)]) - np.eye(len(kept))
    assert left.max() <= 0.9 and kept
    with pytest.raises(ValueError, match="constant"):
        correlation.greedy_drop(np.array([[np.nan]]), 0.9)


def test_correlation_forms(spark):
    x = np.random.default_rng(2).normal(size=(30, 5))
    want = np.corrcoef(x.T)
    got = {(r["f1"], r["f2"]): r["r"] for r in correlation.pairs(feature_rows(spark, x)).collect()}
    long = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(30) for j in range(5)], "sequence_id long, kmer_idx long, freq double")
    also = {(r["f1"], r["f2"]): r["r"] for r in correlation.long_pairs(long, 30).collect()}
    for i in range(5):
        for j in range(i + 1, 5):
            assert np.isclose(got[(i, j)], want[i, j]) and np.isclose(also[(i, j)], want[i, j])
    with pytest.raises(ValueError, match="missing"):
        correlation.matrix(feature_rows(spark, [[1, float("nan")], [2, 3]]))


def test_dendrogram():
    r = np.array([[1, 0.9, 0.1, 0.1], [0.9, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.8], [0.1, 0.1, 0.8, 1]])
    merges = correlation.dendrogram(r)
    assert [(a, b, round(h, 3)) for _, a, b, h in merges] == [(0, 1, 0.1), (2, 3, 0.2), (4, 5, 0.9)]
    assert correlation.cut(merges, 4, 2) == [0, 0, 1, 1] and sorted(correlation.leaf_order(merges, 4)) == [0, 1, 2, 3]
    assert [correlation.block_count(p) for p in (3, 40, 200)] == [2, 5, 8]


def test_scaling_and_pca(spark):
    x = np.random.default_rng(3).normal(size=(40, 4)) * [1, 2, 3, 0] + 5
    s = embed.standardize(feature_rows(spark, x))
    got = np.array([r["features"] for r in s.orderBy("vec_id").collect()])
    assert np.allclose(got.mean(0), 0) and np.allclose(got[:, :3].std(0), 1) and (got[:, 3] == 0).all()
    scores, ratio = embed.pca(s)
    p = np.array([[r["PC1"], r["PC2"]] for r in scores.orderBy("vec_id").collect()])
    _, d, vt = np.linalg.svd(got, full_matrices=False)
    assert np.allclose(np.abs(p), np.abs(got @ vt[:2].T)) and np.allclose(ratio, (d**2 / (d**2).sum())[:2])
    assert embed.ellipses(scores.withColumn("genus", F.lit("g"))).first()["n"] == 40
    assert (embed.perplexity(30, 10), embed.perplexity(30, 1000), embed.neighbours(15, 4)) == (5, 30, 3)
    y = embed.tsne(s, key="vec_id", rounds=30)
    assert y.count() == 40 and np.isfinite(np.array(y.select("TSNE1", "TSNE2").collect())).all()


def test_counts_as_arrays(spark):
    """The same as counting windows one by one, of any letters; nothing is made of a window's text."""
    rows = [("a", "ACGUNacguAA" * 3), ("b", ""), ("c", None), ("d", "AC"), ("e", "ACÄGU😀ACG\nACG"), ("f", "ACGU" * 500)]
    df = seqs(spark, rows)
    for p in (Kmers(3), Kmers(1), Kmers(2, "UÄA")):
        got = df.select("sequence_id", kmers.counted(F.col("sequence"), p).alias("n"))
        assert not any(x in got._jdf.queryExecution().executedPlan().toString() for x in ("regexp_extract_all", "UDF("))
        found = {r["sequence_id"]: r["n"] for r in got.collect()}
        words = [r["kmer"] for r in kmers.vocabulary(spark, p).orderBy("kmer_idx").collect()]
        for name, s in rows:
            s = (s or "").upper()
            cut = [s[i : i + p.k] for i in range(len(s) - p.k + 1)]
            assert found[name] == [cut.count(w) for w in words]
