import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.config import Boosting
from kmerloom.operators import boosting, explain, models


def table(spark, n=240, classes=3, features=5, seed=1, levels=12):
    """Class-dependent features with few distinct values, so that bins hold one value each."""
    r = np.random.default_rng(seed)
    y = r.integers(0, classes, n)
    x = np.round(r.normal(size=(n, features)) * 2 + np.arange(features) * y[:, None] * 0.4) / levels
    return x, y, spark.createDataFrame([(int(i), float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x, strict=True))], "i int, y double, features array<double>")


def plain(x, y, ids, p, rounds):
    """The same model by loops: every split of every node on every value, margins of each round."""
    n, k = len(y), int(y.max()) + 1
    shrink = lambda g: math.copysign(max(abs(g) - p.l1, 0), g)
    worth = lambda g, h: shrink(g) ** 2 / (h + p.l2)
    m, out = np.zeros((n, k)), []
    for number in range(rounds):
        e = np.exp(m)
        q = e / e.sum(1, keepdims=True)
        use = boosting.sampled(ids, number, p)
        step = np.zeros((n, k))
        for c in range(k):
            g, h = q[:, c] - (y == c), np.maximum(2 * q[:, c] * (1 - q[:, c]), 1e-16)
            allowed = boosting.columns(number, c, x.shape[1], p)

            def leaf(rows, depth, g=g, h=h, allowed=allowed):
                own = rows[use[rows]]
                best = (1e-6, None, None)
                if depth < p.depth:
                    total = worth(g[own].sum(), h[own].sum())
                    for f in allowed:
                        for v in np.unique(x[:, f])[1:]:
                            a, b = own[x[own, f] < v], own[x[own, f] >= v]
                            if len(a) and len(b) and h[a].sum() >= p.least_child and h[b].sum() >= p.least_child:
                                gain = worth(g[a].sum(), h[a].sum()) + worth(g[b].sum(), h[b].sum()) - total
                                if gain > best[0] + 1e-9:
                                    best = (gain, f, v)
                if best[1] is None:
                    step[rows, c] = -p.rate * shrink(g[own].sum()) / (h[own].sum() + p.l2)  # noqa: B023
                else:
                    _, f, v = best
                    leaf(rows[x[rows, f] < v], depth + 1)
                    leaf(rows[x[rows, f] >= v], depth + 1)

            leaf(np.arange(n), 0)
        m = m + step
        out.append(m)
    return out


@pytest.mark.parametrize("p", [Boosting(depth=3, bins=200), Boosting(depth=2, bins=200, subsample=1.0, columns=1.0, l1=0.0, l2=0.5, least_child=3.0, seed=3)])
def test_equal_to_a_plain_version(spark, p, monkeypatch):
    """Over two stretches of rounds, so that margins are stored in between."""
    monkeypatch.setattr(boosting, "ROUNDS", 2)
    from dataclasses import replace

    x, y, df = table(spark)
    ids = np.array([r[0] for r in df.orderBy("i").select(F.xxhash64("features", F.col("y"))).collect()])
    fitted = boosting.fit(df, None, replace(p, rounds=3))
    want = plain(x, y, ids, p, 3)
    for rounds in (1, 2, 3):
        got = boosting.BoostedTrees(fitted.trees[:rounds], fitted.cuts, []).margins(x)
        assert np.allclose(got, want[rounds - 1], atol=1e-9)
    proba = {r["i"]: r for r in fitted.transform(df).collect()}
    e = np.exp(want[-1])
    assert np.allclose([proba[i]["proba"] for i in range(len(y))], e / e.sum(1, keepdims=True))
    clear = np.flatnonzero(np.diff(np.sort(want[-1], 1)[:, -2:])[:, 0] > 1e-9)  # not tied
    assert len(clear) > 150 and all(proba[int(i)]["pred"] == want[-1][i].argmax() for i in clear)


def test_stops_early_at_the_best_round(spark):
    """Validation rows with labels of their own: the loss soon rises, and what comes after the best round goes."""
    x, y, df = table(spark, 120)
    other = df.withColumn("y", F.when(F.rand(3) < 0.5, F.col("y")).otherwise(F.floor(F.rand(4) * 3).cast("double"))).cache()
    p = Boosting(rounds=60, depth=3, rate=0.5, patience=3)
    fitted = boosting.fit(df, other, p)
    assert len(fitted.losses) < 60 and len(fitted.trees) == int(np.argmin(fitted.losses[: len(fitted.trees) + p.patience])) + 1
    held = other.toPandas()
    y_ = held["y"].to_numpy().astype(int)
    for rounds in (1, len(fitted.trees)):
        q = boosting.shares(boosting.BoostedTrees(fitted.trees[:rounds], fitted.cuts, []).margins(np.stack(held["features"])))
        assert np.isclose(-np.log(q[np.arange(len(y_)), y_]).mean(), fitted.losses[rounds - 1])
    assert boosting.best_round([5, 4, 3, 3.5, 3.4, 2], 2) == (3, True) and boosting.best_round([5, 4, 3, 3.5, 3.4, 2], 5) == (6, False)


def test_saved_attributed_and_odd_inputs(spark, tmp_path):
    x, y, df = table(spark, 90)
    df = df.withColumn("features", F.concat("features", F.array(F.lit(7.0))))  # a constant feature
    fitted = models.train("boosted_trees", df, df, boosting=Boosting(rounds=3, depth=2))
    models.save(fitted, str(tmp_path / "m"), ["a", "b", "c"])
    again, classes = models.restore(str(tmp_path / "m"))
    assert classes == ["a", "b", "c"] and again.trees == fitted.trees and again.losses == fitted.losses
    assert all((a == b).all() for a, b in zip(again.cuts, fitted.cuts, strict=True)) and len(fitted.cuts[5]) == 0
    names = [f"f{i}" for i in range(6)]
    ranked = dict(models.importances(fitted, names))
    assert np.isclose(sum(ranked.values()), 1) and ranked["f5"] == 0
    trees = explain.trees_of(spark, fitted)
    values = explain.explain(df, trees, names, "i")
    total = {(r["i"], r["class"]): r["s"] for r in values.groupBy("i", "class").agg(F.sum("shap").alias("s")).collect()}
    base = sum(explain.expected(t) for t in trees)
    m = fitted.margins(np.column_stack([x, np.full(len(y), 7.0)]))
    assert np.allclose([[total.get((i, c), 0.0) + base[c] for c in range(3)] for i in range(len(y))], m)
    one = boosting.fit(df.filter("y = 0"), None, Boosting(rounds=1))
    assert one.classes == 1 and set(r["pred"] for r in one.transform(df).collect()) == {0.0}


def test_rows_of_one_partition_are_dealt_and_sums_are_arrays(spark):
    """Small rows come in one partition, yet every level visits them all; a node's sums are one row a task, not one a bin."""
    r = np.random.default_rng(6)
    rows = spark.createDataFrame([(i % 3, r.normal(size=4).tolist()) for i in range(400)], "y int, features array<double>").coalesce(1)
    p = Boosting(depth=2, bins=8)
    ready = boosting.binned(rows, boosting.cut_points(rows, p), 3)
    assert ready.select(F.spark_partition_id()).distinct().count() >= 4
    assert boosting.SUMS.split()[-1] == "binary"
    best = boosting.level(ready, [], [boosting.Growing() for _ in range(3)], [[0]] * 3, 0, 4, p)
    assert sorted((b["class"], b["node"]) for b in best) == [(0, 0), (1, 0), (2, 0)]


def test_a_class_whose_tree_is_done_before_the_others(spark):
    """No row is of class 1, so that its trees have no split and no live node from the second level on."""
    r = np.random.default_rng(8)
    y = r.integers(0, 2, 200) * 2
    x = r.normal(size=(200, 3)) + y[:, None] * [1.0, 0.0, 0.0] + np.square(r.normal(size=(200, 3)))
    rows = spark.createDataFrame([(int(c), v.tolist()) for c, v in zip(y, x, strict=True)], "y int, features array<double>")
    fitted = boosting.fit(rows, None, Boosting(rounds=2, depth=3, bins=16))
    assert all(max(trees[0].left) > 1 and trees[1].left == [-1] and max(trees[2].left) > 1 for trees in fitted.trees)
