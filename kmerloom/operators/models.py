"""Tree ensembles on feature arrays: a weighted random forest, multi-class boosting, grouped cross-validation."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Boosting, Forest
from . import boosting, evaluate
from .boosting import BoostedTrees
from .split import group_folds

MODELS = ("random_forest", "boosted_trees")


def prepare(rows: DataFrame, label: str = "genus", features: str = "features") -> DataFrame:
    """v (vector), y (class number, classes in their order), w (balanced weight)."""
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(rows.withColumn(label, F.col(label).cast("string")))
    out = index.transform(rows.withColumn(label, F.col(label).cast("string"))).withColumn("v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    return out.join(F.broadcast(evaluate.class_weights(out, "y").withColumnRenamed("weight", "w")), "y")


def train_forest(rows: DataFrame, p: Forest = Forest()) -> Transformer:  # noqa: B008
    rows = rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)  # small rows may come in one partition; every level of trees visits them all
    return RandomForestClassifier(featuresCol="v", labelCol="y", weightCol="w", numTrees=p.trees, maxDepth=p.depth, minInstancesPerNode=p.min_leaf, featureSubsetStrategy="sqrt", seed=p.seed).fit(rows)


def train_boosted(rows: DataFrame, validation: DataFrame | None = None, p: Boosting = Boosting()) -> BoostedTrees:  # noqa: B008
    """Where there are validation rows, the rounds up to the best one there are kept."""
    return boosting.fit(rows, validation, p)


def predict(model: Transformer | BoostedTrees, rows: DataFrame) -> DataFrame:
    """Rows with pred and proba (an array)."""
    if isinstance(model, BoostedTrees):
        return model.transform(rows)
    return model.transform(rows).withColumn("proba", vector_to_array("probability")).withColumn("pred", F.col("prediction")).drop("rawPrediction", "probability", "prediction")


def train(name: str, rows: DataFrame, validation: DataFrame | None = None, forest: Forest = Forest(), boosting: Boosting = Boosting()):  # noqa: B008
    if name == "random_forest":
        return train_forest(rows, forest)
    if name == "boosted_trees":
        return train_boosted(rows, validation, boosting)
    raise ValueError(f"unknown model {name}: one of {', '.join(MODELS)}")


def cross_validate(name: str, rows: DataFrame, group: str = "accession", folds: int = 5, **parameters) -> DataFrame | None:
    """fold and score (macro F1); None if a class has fewer than two groups. Training rows only, no early stopping."""
    assigned = group_folds(rows, "y", group, folds)
    if assigned is None:
        warnings.warn("a class has fewer than two groups: no cross-validation", stacklevel=2)
        return None
    dealt = rows.join(assigned, group).cache()
    scores = []
    for f in sorted(r[0] for r in assigned.select("fold").distinct().collect()):
        model = train(name, dealt.filter(F.col("fold") != f), None, **parameters)
        c = evaluate.confusion(predict(model, dealt.filter(F.col("fold") == f)))
        scores.append((f, float(evaluate.summary(c).first()["macro_f1"])))
    dealt.unpersist()
    return rows.sparkSession.createDataFrame(scores, "fold int, score double")


def importances(model: Transformer | BoostedTrees, names: list[str]) -> list[tuple[str, float]]:
    """(kmer, importance), most important first; of boosted trees the mean gain of a feature's splits."""
    values = model.importances() if isinstance(model, BoostedTrees) else model.featureImportances.toArray()
    return sorted(((n, float(v)) for n, v in zip(names, values, strict=False)), key=lambda x: (-x[1], x[0]))


_NODES = "round int, class int, node int, feature int, bin int, left int, right int, gain double, g double, h double, n double, value double"
_ABOUT = "kind string, classes array<string>, cuts array<array<double>>, losses array<double>"


def save(model: Transformer | BoostedTrees, path: str, classes: list[str] = ()) -> None:
    """Always written anew: the trees, and then in ``about`` the kind, the classes in the order of their numbers, and what boosting knows."""
    spark, boosted = SparkSession.active(), isinstance(model, BoostedTrees)
    if boosted:
        nodes = [(r, c, i, *(getattr(t, n)[i] for n in ("feature", "bin", "left", "right", "gain", "g", "h", "n", "value"))) for r, of in enumerate(model.trees) for c, t in enumerate(of) for i in range(len(t.feature))]
        spark.createDataFrame(nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")  # bounded by the model's parameters
    else:
        PipelineModel([model]).write().overwrite().save(f"{path}/0")
    about = [(MODELS[boosted], list(classes), [c.tolist() for c in model.cuts] if boosted else [], list(model.losses) if boosted else [])]
    spark.createDataFrame(about, _ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def restore(path: str) -> tuple[Transformer | BoostedTrees, list[str]]:
    """What save() has written, ready for predict(), and its classes."""
    spark = SparkSession.active()
    about = spark.read.schema(_ABOUT).parquet(f"{path}/about").first()
    if about["kind"] == "random_forest":
        return PipelineModel.load(f"{path}/0").stages[0], about["classes"]
    trees: dict[int, dict[int, boosting.Growing]] = {}
    for r in spark.read.schema(_NODES).parquet(f"{path}/nodes").orderBy("round", "class", "node").collect():
        tree = trees.setdefault(r["round"], {}).setdefault(r["class"], boosting.Growing(*([] for _ in range(9))))
        for name in ("feature", "bin", "left", "right", "gain", "g", "h", "n", "value"):
            getattr(tree, name).append(r[name])
    return BoostedTrees([[of[c] for c in sorted(of)] for _, of in sorted(trees.items())], [np.array(c) for c in about["cuts"]], about["losses"]), about["classes"]
