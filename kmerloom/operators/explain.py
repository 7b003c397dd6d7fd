"""Attributions of tree ensembles: exact path-dependent Shapley values, from the saved trees' node tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.fasta import shared_folder
from .models import BoostedTrees


#: Rows, features and leaves (see shapley_sum) that a task holds at once, and the leaves among them.
CELLS, LEAVES = 4_000_000, 64
#: Parts that rows are dealt over, for each task that can run at a time.
PARTS = 2


@dataclass
class Tree:
    """Node arrays; leaves have left = -1. value: a row for each node and a column for each class."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray


def trees_of(spark: SparkSession, model, folder: str | None = None) -> list[Tree]:
    """The trees of a fitted forest, leaf values as class shares divided by the number of trees; those of boosted trees with leaf margins, of each class in its column."""
    if isinstance(model, BoostedTrees):
        out = []
        for c, t in ((c, t) for of_round in model.trees for c, t in enumerate(of_round)):
            value = np.zeros((len(t.feature), model.classes))
            value[:, c] = t.value
            # a bin's last value goes left: the threshold is just below the next bin's first
            threshold = [np.nextafter(model.cuts[f][b], -np.inf) if f >= 0 else 0.0 for f, b in zip(t.feature, t.bin, strict=True)]
            out.append(Tree(np.array(t.feature), np.array(threshold), np.array(t.left), np.array(t.right), np.array(t.n), value))
        return out
    nodes = _nodes(spark, model, folder or shared_folder(spark, "model"))
    starts = np.flatnonzero(np.diff(nodes["tree"], prepend=-1))
    share = nodes["stats"] / np.maximum(nodes["stats"].sum(1, keepdims=True), 1e-300) / len(starts)
    return [Tree(*(nodes[c][a:b] for c in ("feature", "threshold", "left", "right", "cover")), share[a:b]) for a, b in zip(starts, [*starts[1:], len(share)], strict=True)]


def _nodes(spark: SparkSession, model, path: str) -> dict[str, np.ndarray]:
    """The trees' node table, saved and read again, by columns; a tree's nodes in their order, one tree after the other. Bounded by the model's parameters."""
    model.write().overwrite().save(path)
    n, leaf = F.col("nodeData"), F.col("nodeData.leftChild") < 0
    child = lambda c: F.when(leaf, -1).otherwise(n[c]).alias(c)
    threshold = F.coalesce(F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)), F.lit(0.0))
    table = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), n["id"].alias("id"), n["split"]["featureIndex"].alias("feature"), threshold.alias("threshold"), child("leftChild"), child("rightChild"), n["rawCount"].cast("double").alias("cover"), n["impurityStats"].alias("stats")).orderBy("tree", "id").toArrow()
    names = {"tree": "tree", "feature": "feature", "threshold": "threshold", "left": "leftChild", "right": "rightChild", "cover": "cover"}
    return {k: table[c].to_numpy() for k, c in names.items()} | {"stats": np.stack(table["stats"].to_numpy())}


def expected(tree: Tree) -> np.ndarray:
    """The mean output over the rows that the tree was made from."""
    leaf = tree.left < 0
    return (tree.value[leaf] * tree.cover[leaf, None]).sum(0) / tree.cover[leaf].sum()


def shapley(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """Values (feature, class) of one row; with expected() they add up to the tree's output."""
    return shapley_rows(tree, x[None], n_features)[0]


def shapley_rows(tree: Tree, x: np.ndarray, n_features: int) -> np.ndarray:
    """Values (row, feature, class) of many rows at once."""
    return shapley_sum([tree], x, n_features)


def shapley_sum(trees: list[Tree], x: np.ndarray, n_features: int) -> np.ndarray:
    """Values (row, feature, class) of many rows, added up over trees.

    For each leaf, the features on its path are players: one that is known passes all or nothing (one), one that isn't
    passes the share of its branch (zero). The mean over all orders of the players is the integral, for t from 0 to 1, of
    the product of all other players' one * t + zero * (1 - t): a polynomial of t, which a few Gauss points add up
    exactly. The products at these points go down the tree with the rows; players' shares of leaves are kept by feature and
    multiplied with the leaves' values, LEAVES of them at once.
    """
    rows, classes = len(x), trees[0].value.shape[1]
    phi = np.zeros((n_features, rows, classes))
    held, values, filled = np.empty((n_features, LEAVES, rows)), np.empty((n_features, LEAVES, classes)), np.zeros(n_features, int)

    def add(f: int) -> None:
        phi[f] += held[f, : filled[f]].T @ values[f, : filled[f]]
        filled[f] = 0

    columns = np.ascontiguousarray(x.T)
    for tree in trees:
        at, weight = np.polynomial.legendre.leggauss(max(1, -(-min(depth(tree), n_features) // 2)))
        known, unknown, weight = (1 + at) / 2, (1 - at) / 2, weight / 2
        # node, features on the path, their zeros, whether a row passes them, and the products at each point
        stack = [(0, (), (), np.empty((0, rows)), np.ones((len(at), rows)))]
        while stack:
            node, players, zeros, ones, product = stack.pop()
            if tree.left[node] < 0:
                if players:
                    of, without = list(players), np.outer(zeros, unknown)
                    passes = (weight * (1 - np.array(zeros)[:, None]) / (without + known)) @ product
                    stops = (-weight / unknown) @ product  # of any player: its zero cancels out
                    slot = filled[of]
                    held[of, slot] = stops + ones * (passes - stops)
                    values[of, slot] = tree.value[node]
                    filled[of] += 1
                    if slot.max() == LEAVES - 1:
                        for f in np.flatnonzero(filled == LEAVES):
                            add(f)
                continue
            f = int(tree.feature[node])
            goes_left = (columns[f] <= tree.threshold[node]).astype(float)
            for child, taken in ((int(tree.left[node]), goes_left), (int(tree.right[node]), 1 - goes_left)):
                part = max(tree.cover[child] / tree.cover[node], 1e-30)
                if f in players:
                    i = players.index(f)
                    zero, both = zeros[i] * part, ones.copy()
                    both[i] = ones[i] * taken
                    new = product * ((zero * unknown)[:, None] + np.outer(known, both[i])) / ((zeros[i] * unknown)[:, None] + np.outer(known, ones[i]))
                    stack.append((child, players, (*zeros[:i], zero, *zeros[i + 1 :]), both, new))
                else:
                    stack.append((child, (*players, f), (*zeros, part), np.concatenate([ones, taken[None]]), product * ((part * unknown)[:, None] + np.outer(known, taken))))
    for f in np.flatnonzero(filled):
        add(f)
    return phi.transpose(1, 0, 2)


def depth(tree: Tree) -> int:
    """Splits on the longest path."""
    level, out = np.array([0]), 0
    while len(level := level[tree.left[level] >= 0]):
        level, out = np.concatenate([tree.left[level], tree.right[level]]), out + 1
    return out


def explain(rows: DataFrame, trees: list[Tree], names: list[str], key: str = "sequence_id", features: str = "features") -> DataFrame:
    """key, class, kmer, shap in long form; zero values are left out. The trees are bounded by the model's parameters.

    Rows are dealt evenly over tasks, however few partitions they come in: one costs a visit to every node of all trees.
    """
    given = rows.sparkSession.sparkContext.broadcast((trees, names))
    kind = dict(rows.dtypes)[key]
    parts = PARTS * rows.sparkSession.sparkContext.defaultParallelism

    def run(batches):
        trees, names = given.value
        for p in batches:
            size = max(1, CELLS // (len(names) * (LEAVES + trees[0].value.shape[1])))
            for i in range(0, len(p), size):
                keys, x = p[key].iloc[i : i + size].to_numpy(), np.array(p[features].iloc[i : i + size].to_list(), float)
                phi = shapley_sum(trees, x, len(names))
                r, f, c = np.nonzero(phi)
                yield pd.DataFrame({key: keys[r], "class": c.astype(np.int64), "kmer": np.array(names, object)[f], "shap": phi[r, f, c]})

    dealt = rows.select(key, F.transform(features, lambda x: x.cast("double")).alias(features)).repartition(parts, key)
    return dealt.mapInPandas(run, f"{key} {kind}, class long, kmer string, shap double")


def strongest(values: DataFrame, n_rows: int, n: int = 15) -> DataFrame:
    """class, kmer, mean_abs of the n strongest features of each class."""
    means = values.groupBy("class", "kmer").agg((F.sum(F.abs("shap")) / n_rows).alias("mean_abs"))
    return means.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("mean_abs"), "kmer")).cast("long")).filter(F.col("rank") <= n)


def strongest_overall(values: DataFrame, n_rows: int, n: int = 20) -> DataFrame:
    return values.groupBy("kmer").agg((F.sum(F.abs("shap")) / n_rows).alias("mean_abs")).orderBy(F.desc("mean_abs"), "kmer").limit(n)
