import numpy as np
import pytest
from pyspark.sql import functions as F

from kmerloom.config import Boosting, Cleaning, Forest, Kmers, Reducing
from kmerloom.operators import evaluate, explain, models
from kmerloom.plans import pipeline
from kmerloom.plans.stages import Stages


def test_scores_by_hand(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (2, 2)], "y int, pred int")
    c = evaluate.confusion(df)
    assert c.count() == 9 and c.agg(F.sum("n")).first()[0] == 5
    s = evaluate.summary(c).first()
    assert np.isclose(s["accuracy"], 0.6) and np.isclose(s["macro_f1"], np.mean([2 / 3, 0.5, 2 / 3]))
    never = evaluate.per_class(evaluate.confusion(spark.createDataFrame([(0, 0), (1, 0)], "y int, pred int")))
    assert {r["label"]: r["precision"] for r in never.collect()} == {0: 0.5, 1: 0.0}
    assert evaluate.report(c).count() == 6
    more = evaluate.confusion(df, labels=[0, 1, 2, 3])
    assert np.isclose(evaluate.summary(more).first()["macro_f1"], s["macro_f1"]) and evaluate.report(more).count() == 7
    assert np.isclose(evaluate.summary(more, True).first()["macro_f1"], s["macro_f1"] * 3 / 4)


def test_roc_with_ties(spark):
    r = np.random.default_rng(0)
    y, score = r.integers(0, 2, 200), np.round(r.random(200), 1)
    df = spark.createDataFrame([("k", float(s), int(v)) for s, v in zip(score, y, strict=True)] + [("none", 0.1, 0)], "class string, score double, positive long")
    areas = {x["class"]: x["auc"] for x in evaluate.auc(evaluate.roc_points(df)).collect()}
    pos, neg = score[y == 1], score[y == 0]
    want = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert set(areas) == {"k"} and np.isclose(areas["k"], want)


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (4.0, 3.0)], "y double, p double")
    y, p = np.array([1, 2, 4.0]), np.array([1, 2.5, 3])
    assert np.isclose(evaluate.r2(df, "y", "p").first()[0], 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    flat = spark.createDataFrame([(1.0, 1.0)], "y double, p double")
    assert evaluate.r2(flat, "y", "p").first()[0] == 1.0 and evaluate.r2(flat.withColumn("p", F.lit(2.0)), "y", "p").first()[0] == 0.0


def data(spark, n=90):
    r = np.random.default_rng(4)
    return spark.createDataFrame([(f"s{i}", "abc"[i % 3], f"acc{i // 3}", [float(i % 3 + 0.2 * r.normal()), float(r.normal()), float(-(i % 3) + 0.3 * r.normal())]) for i in range(n)], "sequence_id string, genus string, accession string, features array<double>")


def test_forest_and_attributions(spark):
    rows = models.prepare(data(spark)).cache()
    model = models.train("random_forest", rows, forest=Forest(trees=6, depth=3, min_leaf=2))
    predicted = models.predict(model, rows)
    assert evaluate.summary(evaluate.confusion(predicted)).first()["accuracy"] > 0.9
    trees = explain.trees_of(spark, model)
    assert len(trees) == 6
    values = explain.explain(rows, trees, ["f0", "f1", "f2"])
    total = {(r["sequence_id"], r["class"]): r["s"] for r in values.groupBy("sequence_id", "class").agg(F.sum("shap").alias("s")).collect()}
    base = sum(explain.expected(t) for t in trees)
    for r in predicted.select("sequence_id", "proba").collect():
        for c in range(3):
            assert np.isclose(total.get((r["sequence_id"], c), 0.0) + base[c], r["proba"][c], atol=1e-6)
    assert explain.strongest(values, 90, 2).count() == 6
    assert models.importances(model, ["f0", "f1", "f2"])[-1][0] == "f1"


def test_boosted_and_folds(spark):
    rows = models.prepare(data(spark, 60)).cache()
    p = Boosting(rounds=4, depth=2, patience=2)
    fitted = models.train("boosted_trees", rows.filter("sequence_id < 's4'"), rows.filter("sequence_id >= 's4'"), boosting=p)
    predicted = models.predict(fitted, rows)
    assert all(np.isclose(sum(r["proba"]), 1) for r in predicted.select("proba").collect())
    assert evaluate.summary(evaluate.confusion(predicted)).first()["accuracy"] > 0.8
    scores = models.cross_validate("random_forest", rows, folds=2, forest=Forest(trees=3, depth=3, min_leaf=1))
    assert scores.count() == 2 and evaluate.cv_summary(scores).first()["mean"] > 0.6
    with pytest.raises(ValueError, match="unknown model"):
        models.train("svm", rows)


def write_genera(spark, folder, n, length=80):
    """Two genera of different composition, n records each, as FASTA files."""
    r = np.random.default_rng(5)
    folder.mkdir()
    for g, weights in (("Ab", [5, 1, 1, 1]), ("Cd", [1, 1, 1, 5])):
        p = np.array(weights) / sum(weights)
        (folder / f"{g}.fa").write_text("".join(f">acc{g}{i % 3000} x\n{''.join(s)}\n" for i, s in enumerate(r.choice(list("ACGU"), (n, length), p=p))))


def plan_lines(df):
    return len(df._jdf.queryExecution().analyzed().toString().splitlines())


SMALL = {"c": Cleaning(min_len=50, max_len=100), "k": Kmers(2), "r": Reducing(cutoff=0.9), "forest": Forest(trees=5, depth=3, min_leaf=1), "boosting": Boosting(rounds=2, depth=2)}


def test_from_folder_to_model(spark, tmp_path):
    write_genera(spark, tmp_path / "in", 15)
    run = pipeline.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), cross_validate=False, which=("random_forest",), **SMALL)
    assert run.summary.count() == 2 and run.features.matrix.count() == 30
    out = run.trained["random_forest"]
    assert run.features.reduced.count() == 30 and len(run.features.kept) <= 16
    assert out.summary["accuracy"] > 0.7 and out.shap is not None and out.roc.count() > 0
    assert {r["metric"] for r in run.diagnosis["dataset_summary"].collect()} >= {"rows", "genera"}
    assert set(pipeline.embeddings(run.features.matrix, epochs=2)) == {"scaled", "pca", "tsne", "umap"}
    # plans end at each stage
    for df in (run.summary, run.features.reduced, run.features.taxonomy, out.test, out.validation, out.shap, *run.diagnosis.values()):
        assert plan_lines(df) < 60
    assert not any(x["found"] for x in run.stages)
    told = Stages(spark, f"{tmp_path}/out/stages").read_note("run_metadata")
    assert [x["stage"] for x in told["stages"]] == [x["stage"] for x in run.stages] and told["parameters"]["kmers"]["k"] == 2
    assert told["metrics"]["random_forest"]["accuracy"] == out.summary["accuracy"] == Stages(spark, f"{tmp_path}/out/stages").read_note("metrics_random_forest")["accuracy"]
    # again: all is found, and gives the same
    again = pipeline.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), cross_validate=False, which=("random_forest",), **SMALL)
    assert all(x["found"] for x in again.stages)
    assert again.trained["random_forest"].summary == out.summary and again.features.kept == run.features.kept
    # another parameter: what comes before it is found
    other = pipeline.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), cross_validate=False, which=("random_forest",), **SMALL | {"forest": Forest(trees=3, depth=2)})
    assert {x["stage"] for x in other.stages if not x["found"]} == {"model", "test_predictions", "validation_predictions", "test_confusion", "test_report", "validation_report", "shap"}


def test_steps_of_the_command_line(spark, tmp_path):
    """Each step takes what the one before has left."""
    from kmerloom.__main__ import parameters, run

    write_genera(spark, tmp_path / "in", 15)
    (tmp_path / "c.toml").write_text("[cleaning]\nmin_len = 50\nmax_len = 100\n[kmers]\nk = 2\n[reducing]\ncutoff = 0.9\n[forest]\ntrees = 3\ndepth = 2\nmin_leaf = 1\n[splitting]\nfolds = 2\n")
    p, out = parameters(str(tmp_path / "c.toml")), tmp_path / "out"
    assert p["forest"] == Forest(3, 2, 1) and p["boosting"] == Boosting() and p["cleaning"].dedup == "forward"
    for step in ("clean", "features", "train", "diagnose"):
        before = {x.name for x in (out / "stages").iterdir()} if step != "clean" else set()
        run(spark, step, str(tmp_path / "in"), str(out), p, ("random_forest",))
        assert before < {x.name for x in (out / "stages").iterdir()}
    assert {x.name for x in out.iterdir()} == {"stages", "clean", "taxonomy", "manifest", "dropped_features", "reduced", "random_forest", "diagnosis"}
    lines = [x for f in (out / "diagnosis" / "summary_text").glob("part-*") for x in f.read_text().splitlines()]
    assert lines[0] == "DATASET DIAGNOSTIC REPORT" and "rows: 30.00" in lines and lines[-1] == "Number of genera: 2"
    (tmp_path / "c.toml").write_text("[kmers]\nlength = 2\n")
    with pytest.raises(ValueError, match="unknown"):
        parameters(str(tmp_path / "c.toml"))


def test_stages_start_again_where_they_broke_off(spark, tmp_path):
    st = Stages(spark, str(tmp_path / "s"))
    made = []
    first = st.table("one", lambda: made.append(1) or spark.range(3), "p", 1)
    with pytest.raises(ZeroDivisionError):
        st.table("two", lambda: first.selectExpr("id", f"{1 // 0}"), first)
    st = Stages(spark, str(tmp_path / "s"))
    first = st.table("one", lambda: made.append(2) or spark.range(3), "p", 1)
    second = st.table("two", lambda: first.selectExpr("id + 1 AS id"), first)
    assert made == [1] and sorted(r[0] for r in second.collect()) == [1, 2, 3]
    assert [x["found"] for x in st.done] == [True, False]
    other = st.table("one", lambda: made.append(3) or spark.range(4), "p", 2)
    assert made == [1, 3] and other.count() == 4
    # a table that no stage made is known by its rows, in any order
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    for rows, found in ((df, False), (df.orderBy(F.desc("a")), True), (df.filter("a = 1"), False)):
        st.table("three", lambda: spark.range(1), rows)
        assert st.done[-1]["found"] is found


def test_thirty_thousand_records(spark, tmp_path):
    write_genera(spark, tmp_path / "in", 15_000)
    run = pipeline.from_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), cross_validate=False, which=("random_forest",), **SMALL)
    assert run.features.matrix.count() == 30_000 and run.trained["random_forest"].summary["accuracy"] > 0.9
    assert all(plan_lines(df) < 60 for df in (run.features.reduced, run.trained["random_forest"].shap))


def test_boosted_attributions(spark):
    rows = models.prepare(data(spark, 60).withColumn("split", F.when(F.col("accession") < "acc12", "val").when(F.col("accession") < "acc3", "test").otherwise("train"))).cache()
    fitted = models.train("boosted_trees", rows.filter("split = 'train'"), None, boosting=Boosting(rounds=3, depth=2))
    trees = explain.trees_of(spark, fitted)
    assert len(trees) == 9
    values = explain.explain(rows, trees, ["f0", "f1", "f2"])
    total = {(r["sequence_id"], r["class"]): r["s"] for r in values.groupBy("sequence_id", "class").agg(F.sum("shap").alias("s")).collect()}
    base = sum(explain.expected(t) for t in trees)
    for r in models.predict(fitted, rows).select("sequence_id", "proba").collect():
        margins = np.array([total.get((r["sequence_id"], c), 0.0) for c in range(3)]) + base
        assert np.allclose(np.exp(margins) / np.exp(margins).sum(), r["proba"], atol=1e-6)
    names = data(spark, 60).select("sequence_id", "genus", "accession")
    out = pipeline.train_and_evaluate(rows.select("sequence_id", "genus", "features", F.col("split")), names.select("sequence_id", "accession"), ["f0", "f1", "f2"], model="boosted_trees", cross_validate=False, boosting=Boosting(rounds=2, depth=2))
    assert out.shap is not None and {r["class"] for r in out.shap.select("class").distinct().collect()} == {0, 1, 2}


def test_registered_forests_are_of_the_default_size(spark, monkeypatch):
    from kmerloom.plans import catalog

    class Seen(Exception):
        pass

    def train(name, rows, validation=None, forest=None):
        assert (name, forest or Forest()) == ("random_forest", Forest())
        raise Seen

    monkeypatch.setattr(models, "train", train)
    for q in ("rf_fit", "shap_top_features"):
        with pytest.raises(Seen):
            catalog.QUERIES[q](spark, "/root/testdata/sf0.001")


def test_attributions_of_many_rows_are_those_of_each():
    r = np.random.default_rng(8)
    tree = explain.Tree(np.array([0, 1, 0, -1, -1, -1, -1]), np.array([0.0, 0.2, 0.5, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]), np.array([2, 4, 6, -1, -1, -1, -1]), np.array([10.0, 6, 4, 1, 5, 3, 1]), r.random((7, 2)))
    x = r.normal(size=(50, 3))
    phi = explain.shapley_rows(tree, x, 3)
    for row, p in zip(x, phi, strict=True):
        at = 0
        while tree.left[at] >= 0:
            at = tree.left[at] if row[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
        assert np.allclose(p.sum(0) + explain.expected(tree), tree.value[at]) and np.allclose(p, explain.shapley(tree, row, 3))


def test_attributions_against_all_coalitions(spark):
    """Several trees with features that come back on a path; rows of one partition are dealt over tasks."""
    from itertools import combinations
    from math import comb

    r = np.random.default_rng(4)

    def grown(depth):
        nodes = []

        def node(n, d):
            i = len(nodes)
            nodes.append([-1, 0.0, -1, -1, n, r.random(2)])
            if d < depth:
                a = int(r.integers(1, n))
                nodes[i][:2] = int(r.integers(4)), float(r.normal())
                nodes[i][2], nodes[i][3] = node(a, d + 1), node(n - a, d + 1)
            return i

        node(10_000, 0)
        return explain.Tree(*(np.array(c) for c in zip(*nodes, strict=True)))

    def output(tree, node, row, known):
        if tree.left[node] < 0:
            return tree.value[node]
        f, sides = tree.feature[node], (tree.left[node], tree.right[node])
        if f in known:
            return output(tree, sides[int(row[f] > tree.threshold[node])], row, known)
        return sum(output(tree, c, row, known) * tree.cover[c] / tree.cover[node] for c in sides)

    trees, x = [grown(d) for d in (5, 4, 0)], r.normal(size=(150, 4))
    phi = explain.shapley_sum(trees, x, 4)
    for i in range(6):
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            want = sum((output(t, 0, x[i], {*s, f}) - output(t, 0, x[i], set(s))) / (4 * comb(3, k)) for t in trees for k in range(4) for s in combinations(rest, k))
            assert np.allclose(phi[i, f], want)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sequence_id long, features array<double>").coalesce(1)
    out = explain.explain(rows, trees, list("abcd"))
    assert {(q["sequence_id"], q["class"], q["kmer"]): q["shap"] for q in out.collect()} == pytest.approx({(i, c, "abcd"[f]): phi[i, f, c] for i in range(150) for f in range(4) for c in range(2) if phi[i, f, c]})
    from pyspark.sql import functions as F

    assert out.select(F.spark_partition_id()).distinct().count() >= 4


def test_models_are_restored_with_classes_and_rounds(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from kmerloom.config import Boosting, Forest
    from kmerloom.operators import models

    r = np.random.default_rng(3)
    rows = spark.createDataFrame([(float(k % 3), [float(k % 3 + x) for x in r.normal(0, 0.3, 4)], 1.0) for k in range(90)], "y double, features array<double>, w double").withColumn("v", array_to_vector("features"))
    boosted = models.train_boosted(rows, rows.filter(F.rand(1) < 0.5), Boosting(rounds=4, depth=2, patience=1))
    for name, model in (("f", models.train_forest(rows, Forest(trees=5, depth=3))), ("b", boosted)):
        models.save(model, str(tmp_path / name), ["a", "b", "c"])
        again, classes = models.restore(str(tmp_path / name))
        assert classes == ["a", "b", "c"] and getattr(again, "losses", None) == getattr(model, "losses", None)
        shown = lambda m: sorted((x["features"], x["pred"], x["proba"]) for x in models.predict(m, rows).collect())
        assert shown(again) == shown(model)
