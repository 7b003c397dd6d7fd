"""Evaluation of predictions: everything follows from one count per (true, predicted) pair and one sorted pass per class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Steps of scores that are counted first, so that no task ranks a whole class.
STEPS = 4096


def confusion(rows: DataFrame, y: str = "y", pred: str = "pred", labels: list | None = None) -> DataFrame:
    """y, pred, n for all pairs of labels that occur on either side, and of those given; n is 0 where a pair doesn't occur."""
    seen = rows.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    known = seen.select(F.col("y").alias("l")).union(seen.select("pred"))
    if labels:
        known = known.union(rows.sparkSession.createDataFrame([(x,) for x in labels], f"l {dict(rows.dtypes)[y]}"))
    known = known.distinct()
    cells = known.select(F.col("l").alias("y"), F.lit(1).alias("one")).join(known.select(F.col("l").alias("pred"), F.lit(1).alias("one")), "one").drop("one")  # classes by classes
    return cells.join(seen, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(c: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support, predicted; a division by zero gives 0."""
    ends = c.select(F.col("y").alias("label"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")).unionByName(c.select(F.col("pred").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")))
    s = ends.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support", "predicted")


def summary(c: DataFrame, all_labels: bool = False) -> DataFrame:
    """accuracy, macro and weighted precision, recall and f1. Macro is over labels present in truth or prediction, or over all of c's."""
    p = per_class(c) if all_labels else per_class(c).filter("support + predicted > 0")
    weighted = lambda m: F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}")
    both = p.agg(*(F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")), *map(weighted, ("precision", "recall", "f1")))
    accuracy = c.agg(F.try_divide(F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))
    return accuracy.crossJoin(both)  # one row each


def report(c: DataFrame) -> DataFrame:
    """A row for each class of c, then accuracy, macro avg (over all of them) and weighted avg."""
    p = per_class(c)
    classes = p.select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", F.col("support").cast("double").alias("support"))
    s = summary(c, True).crossJoin(c.agg(F.sum("n").cast("double").alias("total")))
    rows = [s.select(F.lit("accuracy").alias("label"), F.col("accuracy").alias("precision"), F.col("accuracy").alias("recall"), F.col("accuracy").alias("f1"), F.col("accuracy").alias("support"))]
    rows += [s.select(F.lit(f"{kind} avg").alias("label"), *(F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")), F.col("total").alias("support")) for kind in ("macro", "weighted")]
    for r in rows:
        classes = classes.unionByName(r)
    return classes


def one_vs_rest(rows: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """class, score, positive: a row for each row and class."""
    return rows.select(F.col(y).alias("y"), F.posexplode(proba).alias("class", "score")).select(F.col("class").cast("long").alias("class"), "score", (F.col("y") == F.col("class")).cast("long").alias("positive"))


def roc_points(scored: DataFrame, label: str = "class", score: str = "score", positive: str = "positive") -> DataFrame:
    """label, score, tp, fp at each distinct score, highest first; classes with only positives or none are left out.

    Ties are counted together before anything is ranked. Running totals are in two levels: within a step
    of the scores' range, and over the steps before it, so no task sorts a whole class.
    """
    ties = scored.groupBy(label, score).agg(F.sum(positive).alias("pos"), F.sum(1 - F.col(positive)).alias("neg"))
    spread = ties.groupBy(label).agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).filter("all_pos > 0 and all_neg > 0")
    step = F.coalesce(F.least(F.floor(F.try_divide((F.col("hi") - F.col(score)) * STEPS, F.col("hi") - F.col("lo"))), F.lit(STEPS - 1)), F.lit(0)).cast("int")
    t = ties.join(spread, label).withColumn("step", step)
    steps = t.groupBy(label, "step").agg(F.sum("pos").alias("step_pos"), F.sum("neg").alias("step_neg"))
    before = Window.partitionBy(label).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    offsets = steps.select(label, "step", F.coalesce(F.sum("step_pos").over(before), F.lit(0)).alias("before_pos"), F.coalesce(F.sum("step_neg").over(before), F.lit(0)).alias("before_neg"))
    within = Window.partitionBy(label, "step").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return t.join(offsets, [label, "step"]).select(label, score, (F.col("before_pos") + F.sum("pos").over(within)).alias("tp"), (F.col("before_neg") + F.sum("neg").over(within)).alias("fp"), "pos", "neg", "all_pos", "all_neg")


def auc(points: DataFrame, label: str = "class") -> DataFrame:
    """label and the area under its curve: trapezoids between neighbouring points."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.first(F.col("all_pos").cast("double") * F.col("all_neg"))
    return points.groupBy(label).agg(area.alias("auc"))


def macro_auc(areas: DataFrame) -> DataFrame:
    return areas.agg(F.avg("auc").alias("macro_auc"))


def r2(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """1 - SSE / SST; without variation 1 if there is no error, else 0. Two passes: the mean first, for exactness."""
    mean = rows.agg(F.avg(y).alias("m"))
    s = rows.crossJoin(F.broadcast(mean)).agg(F.sum((F.col(y) - F.col(pred)) ** 2).alias("sse"), F.sum((F.col(y) - F.col("m")) ** 2).alias("sst"))
    return s.select(F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0).alias("r2"))


def r2_probabilities(rows: DataFrame, y: str = "y", proba: str = "proba") -> DataFrame:
    """The mean over classes of R2 between the one-hot truth and the probabilities."""
    long = one_vs_rest(rows, y, proba)
    mean = long.groupBy("class").agg(F.avg("positive").alias("m"))
    s = long.join(F.broadcast(mean), "class").groupBy("class").agg(F.sum((F.col("positive") - F.col("score")) ** 2).alias("sse"), F.sum((F.col("positive") - F.col("m")) ** 2).alias("sst"))
    return s.select(F.when(F.col("sst") > 0, 1 - F.try_divide("sse", "sst")).when(F.col("sse") == 0, 1.0).otherwise(0.0).alias("r2")).agg(F.avg("r2").alias("r2"))


def class_weights(rows: DataFrame, label: str = "genus") -> DataFrame:
    """label and n / (classes * n of the class)."""
    c = rows.groupBy(label).agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"), F.count("*").alias("classes")))).select(label, (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
