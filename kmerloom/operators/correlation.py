"""Correlated features: matrix, pairs, histogram, network, clustering, and their greedy reduction on training rows."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Reducing
from ..functions.sequences import has_missing

#: Features whose square matrix the driver may hold: 8,192 take half a gigabyte.
MOST_FEATURES = 8192


def matrix(rows: DataFrame, features: str = "features", method: str = "pearson") -> np.ndarray:
    """All correlations on the driver, behind a check of their number; sums are combined over the rows' tasks."""
    one = rows.agg(F.max(F.size(features)).alias("n"), F.max(has_missing(F.transform(features, lambda x: x.cast("double")))).alias("missing")).first()
    if one["missing"]:
        raise ValueError("features have missing values")
    if (one["n"] or 0) > MOST_FEATURES:
        raise ValueError(f"{one['n']} features are more than {MOST_FEATURES}: use long_pairs()")
    vectors = rows.select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("v"))
    return Correlation.corr(vectors, "v", method).first()[0].toArray()


def pairs(rows: DataFrame, features: str = "features", method: str = "pearson") -> DataFrame:
    """f1 < f2 and their correlation; pairs with a constant feature have none and are left out."""
    r = matrix(rows, features, method)
    i, j = np.triu_indices(len(r), 1)
    fine = ~np.isnan(r[i, j])
    import pandas as pd

    return rows.sparkSession.createDataFrame(pd.DataFrame({"f1": i[fine].astype(np.int64), "f2": j[fine].astype(np.int64), "r": r[i, j][fine]}), "f1 long, f2 long, r double")


def long_pairs(long: DataFrame, n: int, key: str = "sequence_id", index: str = "kmer_idx", value: str = "freq") -> DataFrame:
    """The same from the long sparse form, for any number of features: products are summed over a join on the sequence."""
    a = long.select(F.col(key).alias("k"), F.col(index).alias("f1"), F.col(value).alias("x"))
    b = long.select(F.col(key).alias("k"), F.col(index).alias("f2"), F.col(value).alias("y"))
    s = long.groupBy(F.col(index).alias("f")).agg(F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss"))
    products = a.join(b, "k").filter("f1 < f2").groupBy("f1", "f2").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    both = products.join(s.select(F.col("f").alias("f1"), F.col("s").alias("s1"), F.col("ss").alias("ss1")), "f1").join(s.select(F.col("f").alias("f2"), F.col("s").alias("s2"), F.col("ss").alias("ss2")), "f2")
    spread = F.sqrt((F.col("ss1") - F.col("s1") ** 2 / n) * (F.col("ss2") - F.col("s2") ** 2 / n))
    return both.select("f1", "f2", F.try_divide(F.col("xy") - F.col("s1") * F.col("s2") / n, spread).alias("r")).filter("r is not null")


def strong(p: DataFrame, cutoff: float) -> DataFrame:
    return p.filter(F.abs("r") > cutoff)


def histogram(p: DataFrame, bins: int = 60) -> DataFrame:
    """bin (1 to bins, of equal width from -1 to 1) and count."""
    at = F.least(F.floor((F.col("r") + 1.0) / (2.0 / bins)).cast("long") + 1, F.lit(bins))
    return p.groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def mean_absolute(p: DataFrame, n_features: int) -> DataFrame:
    """idx and the mean of its absolute correlations; the diagonal counts as a zero."""
    ends = p.select(F.col("f1").alias("idx"), F.abs("r").alias("a")).unionByName(p.select(F.col("f2").alias("idx"), F.abs("r").alias("a")))
    return ends.groupBy("idx").agg((F.sum("a") / n_features).alias("mean_abs"))


def network_degree(p: DataFrame, cutoff: float = Reducing.network) -> DataFrame:
    """idx and how many features it is tied to; features without ties have no row."""
    e = strong(p, cutoff)
    return e.select(F.col("f1").alias("idx")).unionByName(e.select(F.col("f2").alias("idx"))).groupBy("idx").agg(F.count("*").alias("degree"))


def greedy_drop(r: np.ndarray, cutoff: float = Reducing.cutoff) -> list[tuple[int, int, float]]:
    """(dropped, kept, absolute correlation): strong pairs, strongest first and equal ones by column then row, lose the one with the larger mean."""
    if np.isnan(r).any():
        raise ValueError("a feature is constant on the rows that the correlations come from")
    a = np.abs(r)
    np.fill_diagonal(a, 0)
    means = a.sum(1) / len(a)
    j, i = np.nonzero(np.tril(a, -1) > cutoff)
    order = sorted(range(len(i)), key=lambda k: (-a[i[k], j[k]], j[k], i[k]))
    gone: set[int] = set()
    log = []
    for k in order:
        x, y = int(i[k]), int(j[k])
        if x in gone or y in gone:
            continue
        drop, stay = (x, y) if means[x] >= means[y] else (y, x)
        gone.add(drop)
        log.append((drop, stay, float(a[x, y])))
    return log


def varying(rows: DataFrame, features: str = "features") -> list[int]:
    """Features that aren't constant over the rows."""
    x = rows.select(F.posexplode(features).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return sorted(r["i"] for r in x.filter("lo < hi").select("i").collect())


def take(rows: DataFrame, kept: list[int], features: str = "features") -> DataFrame:
    """Only some features, in the given order."""
    return rows.withColumn(features, F.transform(F.array(*map(F.lit, kept)), lambda i: F.get(F.col(features), i)) if kept else F.array().cast("array<double>"))


def reduce_features(rows: DataFrame, p: Reducing = Reducing(), features: str = "features") -> tuple[DataFrame, list[int], list[tuple[int, int, float]]]:  # noqa: B008
    """All rows with the features that training rows say to keep, those features, and what was dropped for what.

    Rows that aren't of the training split have no say; without a split all rows are fitted on.
    """
    fit = rows.filter("split = 'train'") if "split" in rows.columns else rows
    alive = varying(fit, features)
    r = matrix(take(fit, alive, features), features, p.method)
    log = [(alive[a], alive[b], c) for a, b, c in greedy_drop(np.atleast_2d(r), p.cutoff)]
    gone = {d for d, _, _ in log}
    kept = [f for f in alive if f not in gone]
    return take(rows, kept, features), kept, log


def dendrogram(r: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(step, left, right, height) of average linkage on 1 - |r|; clusters made by step s are numbered n + s.

    By a chain of nearest neighbours, whose last two merge when each is the other's nearest: average linkage never makes a
    cluster nearer than its parts were, so the rest of the chain stays valid and all takes O(n^2). Merges are then put in
    the order of their heights, equal ones as they were found.
    """
    n = len(r)
    d = 1 - np.abs(np.asarray(r, dtype=float))
    np.fill_diagonal(d, np.inf)
    size, height, alive = np.ones(n), np.zeros(n), np.ones(n, bool)
    found, chain = [], []
    while len(found) < n - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        x = chain[-1]
        y = int(np.argmin(d[x]))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
            del chain[-2:]
            keep, gone = min(x, y), max(x, y)  # a cluster goes by its smallest feature
            h = max(float(d[x, y]), height[x], height[y])
            found.append((h, keep, gone))
            row = (size[x] * d[x] + size[y] * d[y]) / (size[x] + size[y])
            row[[keep, gone]] = np.inf
            d[keep], d[:, keep] = row, row
            d[gone], d[:, gone] = np.inf, np.inf
            size[keep], height[keep], alive[gone] = size[x] + size[y], h, False
        else:
            chain.append(y)
    name, out = list(range(n)), []
    for step, (h, keep, gone) in enumerate(sorted(found, key=lambda f: f[0])):
        out.append((step, *sorted((name[keep], name[gone])), h))
        name[keep] = n + step
    return out


def leaf_order(merges: list[tuple[int, int, int, float]], n: int) -> list[int]:
    """Leaves from left to right: the order of a heatmap's rows."""
    if not merges:
        return list(range(n))
    children = {n + s: (a, b) for s, a, b, _ in merges}
    out, stack = [], [n + merges[-1][0]]
    while stack:
        x = stack.pop()
        if x < n:
            out.append(x)
        else:
            stack += reversed(children[x])
    return out


def block_count(p: int) -> int:
    """Clusters that an ordered correlogram marks."""
    return max(2, min(8, p // 8))


def cut(merges: list[tuple[int, int, int, float]], n: int, clusters: int) -> list[int]:
    """The cluster of each leaf once only so many are left."""
    of = {i: [i] for i in range(n)}
    for step, a, b, _ in merges[: n - clusters]:
        of[n + step] = of.pop(a) + of.pop(b)
    out = [0] * n
    for c, leaves in enumerate(sorted(of.values(), key=min)):
        for leaf in leaves:
            out[leaf] = c
    return out
