import numpy as np
from pyspark.sql import functions as F

from kmerloom.operators import embed, tsne


def places(spark, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(y)], "id long, u double, v double")


def near(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def test_interpolated_repulsion_is_that_of_all_pairs(spark):
    y = np.random.default_rng(1).normal(size=(400, 2)) * [12, 5]
    y[:30] = y[0]  # copies
    diff = y[:, None] - y[None]
    num = 1 / (1 + (diff**2).sum(2))
    z = num.sum() - len(y)
    want = (num[:, :, None] ** 2 * diff).sum(1) / z
    r = tsne.repulsion(places(spark, y), len(y))
    assert abs(r.normaliser / z - 1) < 0.01
    assert np.abs(r.at(y) - want).max() < 0.03 * np.abs(want).max()
    one = tsne.repulsion(places(spark, np.zeros((5, 2))), 5)
    assert np.isfinite(one.at(np.zeros((5, 2)))).all()


def test_shares_have_the_wanted_perplexity(spark):
    d2 = np.random.default_rng(2).random((6, 40)) * 9
    p = tsne.conditional(d2.ravel(), np.repeat(np.arange(6), 40), 6, 12).reshape(6, 40)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p)).sum(1)), 12)
    assert np.allclose(tsne.conditional(np.zeros(4), np.zeros(4, int), 1, 2), 0.25)
    rows = [(i, j, float(abs(i - j))) for i in range(8) for j in range(8) if i != j]
    got = tsne.affinities(spark.createDataFrame(rows, "id long, other long, d double"), 8, 3).collect()
    p = {(r["id"], r["other"]): r["p"] for r in got}
    assert len(p) == 56 and np.isclose(sum(p.values()), 1) and all(np.isclose(v, p[j, i]) for (i, j), v in p.items())


def test_all_rows_are_placed_and_neighbours_kept(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 1.0, (200, 10)) for c in r.normal(size=(4, 10)) * 6])
    rows = spark.createDataFrame([(f"s{i}", v.tolist()) for i, v in enumerate(x)], "sequence_id string, features array<double>").repartition(4)

    def laid(moves):
        out = {q["sequence_id"]: (q["TSNE1"], q["TSNE2"]) for q in embed.tsne(rows, landmarks=200, moves=moves).collect()}
        assert len(out) == 800
        return np.array([out[f"s{i}"] for i in range(800)])

    own, before, after = near(x, 15), laid(0), laid(8)
    kept = lambda y: np.mean([len(set(a) & set(b)) for a, b in zip(own, near(y, 15), strict=True)]) / 15
    assert np.isfinite(after).all() and np.mean(near(after, 10) // 200 == (np.arange(800) // 200)[:, None]) > 0.95
    assert kept(after) > kept(before), (kept(after), kept(before))
    print(kept(before), kept(after))


def test_few_rows_and_copies(spark):
    rows = spark.createDataFrame([(f"s{i}", [1.0, 2.0]) for i in range(12)], "sequence_id string, features array<double>")
    assert [embed.tsne(rows.limit(n)).count() for n in (0, 2)] == [0, 2]
    same = embed.tsne(rows, landmarks=5, moves=2, rounds=20)
    assert same.count() == 12 and np.isfinite(np.array(same.select("TSNE1", "TSNE2").collect())).all()
    assert embed.tsne(rows.withColumn("u", F.lit("x")), rounds=20).columns == ["sequence_id", "TSNE1", "TSNE2"]


def test_edges_in_buckets_are_not_shuffled_again(spark):
    """Of the two sides of a join by the buckets' key only the other one is; the table goes with its files."""
    from kmerloom.sources.stored import dealt, discard

    before, setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")
    try:
        ties = dealt(spark.range(2000).selectExpr("id", "id % 50 as other", "1.0D as p"), "some-ties", "other")
        both = ties.join(spark.range(50).withColumnRenamed("id", "other"), "other")
        assert both.count() == 2000 and both._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert ties.join(spark.range(50).withColumnRenamed("id", "other"), "other").agg(F.sum("id")).first()[0] == 1999000
        discard(ties)
        assert not spark.catalog.tableExists(ties.__dict__["table"])
        made = []
        real, tsne.dealt = tsne.dealt, lambda *a: made.append(real(*a)) or made[-1]
        try:
            start = places(spark, np.random.default_rng(1).normal(size=(40, 2)))
            p = spark.createDataFrame([(i, (i + s) % 40, 1 / 80) for i in range(40) for s in (1, 39)], "id long, other long, p double")
            assert tsne.moved(start, p, 40, 2).count() == 40
        finally:
            tsne.dealt = real
        assert len(made) == 1 and not spark.catalog.tableExists(made[0].__dict__["table"])
    finally:
        spark.conf.set(setting, before)
