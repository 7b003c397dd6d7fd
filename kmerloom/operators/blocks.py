"""Correlations of many features by blocks, for which neither the driver nor a task holds the square matrix.

A task turns lots of rows into standard scores, as many rows as LOT bytes hold, and multiplies every two blocks of
features. Products leave as strips of a feature with one block, and are summed as they stream by, first over SALTS shares
of the lots, so that few features over many rows keep many tasks busy, then over the shares. What leaves a finished strip is
its pairs above the cutoff. The driver holds two numbers for each feature.

Rows with a missing value in a feature are an error, as are rows of different lengths. Pairs with a constant feature have
no correlation and are left out; no rows give no pairs. Copies of a row count as often as they are there.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sequences import has_missing
from ..sources.stored import stored
from .stats import feature_statistics

#: Features of a block, bytes of standard scores that a task holds at once, and shares in which a strip is summed first.
BLOCK, LOT, SALTS = 128, 1 << 26, 32

_STRIPS = "a int, b int, salt int, products binary"


def _strips(a, b, salt, products: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(salt, pa.int32()), pa.array([p.tobytes() for p in products], pa.binary())], ["a", "b", "salt", "products"])


def _summed(batches, block: int):
    """(a, b, salt, sums) of strips that come sorted by these, a batch at a time; the last key of a batch waits for the next."""
    keys, held = np.zeros((0, 3), np.int64), np.zeros((0, block))
    for t in chain(batches, [None]):
        if t is not None:
            if not t.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([t[c].to_numpy() for c in ("a", "b", "salt")], 1)])
            held = np.concatenate([held, np.frombuffer(b"".join(t["products"].to_pylist())).reshape(-1, block)])
        if len(keys):
            starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
            sums, keys = np.add.reduceat(held, starts, 0), keys[starts]
            whole = len(keys) if t is None else len(keys) - 1
            yield keys[:whole, 0], keys[:whole, 1], keys[:whole, 2], sums[:whole]
            keys, held = keys[whole:], sums[whole:]


def pairs(rows: DataFrame, cutoff: float = 0.0, features: str = "features", block: int = BLOCK, lot: int = LOT) -> DataFrame:
    """f1 < f2 and their Pearson correlation r, where its absolute value is above the cutoff (at 0: wherever there is any)."""
    spark, x = rows.sparkSession, F.transform(features, lambda v: v.cast("double"))
    told = rows.agg(F.min(F.size(features)).alias("least"), F.max(F.size(features)).alias("most"), F.max(has_missing(x)).alias("missing")).first()
    if told["missing"] or told["least"] != told["most"]:
        raise ValueError("features have missing values or different lengths")
    if not told["most"]:
        return spark.createDataFrame([], "f1 long, f2 long, r double")
    s = sorted(feature_statistics(rows.select(x.alias("x")), "x").select("idx", "mean", "std", "rows", "minimum", "maximum").collect())  # a row for each feature
    mean, n = np.array([r["mean"] for r in s]), s[0]["rows"]
    spread = np.array([r["std"] if r["minimum"] < r["maximum"] else np.nan for r in s]) * np.sqrt(max(n - 1, 1))
    given = spark.sparkContext.broadcast((mean, spread))
    m, at_once = len(s), max(1, lot // (8 * len(s)))

    def multiply(batches):
        mean, spread = given.value
        task, turn, held, count = TaskContext.get().partitionId(), 0, [], 0
        for b in chain(batches, [None]):
            left = np.zeros((0, m)) if b is None else b["x"].flatten().to_numpy().reshape(-1, m)
            while len(left) or (b is None and count):
                held.append((left[: at_once - count] - mean) / spread)
                count, left = count + len(held[-1]), left[at_once - count :]
                if count == at_once or b is None:
                    z = np.concatenate(held)
                    turn, held, count = turn + 1, [], 0
                    for i in range(0, m, block):
                        for j in range(i, m, block):
                            tile = z[:, i : i + block].T @ z[:, j : j + block]
                            tile = np.pad(tile, ((0, 0), (0, block - tile.shape[1])))
                            yield _strips(np.arange(i, i + len(tile)), np.full(len(tile), j), np.full(len(tile), (task + 7 * turn) % SALTS), tile)

    def add(batches):
        for part in _summed(batches, block):
            yield _strips(*part)

    def finish(batches):
        for a, b, _, r in _summed(batches, block):
            other = b[:, None] + np.arange(block)
            with np.errstate(invalid="ignore"):
                row, at = np.nonzero((np.abs(r) > cutoff if cutoff else ~np.isnan(r)) & (other > a[:, None]) & (other < m))
            yield pa.RecordBatch.from_arrays([pa.array(a[row]), pa.array(other[row, at]), pa.array(np.clip(r[row, at], -1, 1))], ["f1", "f2", "r"])

    strips = rows.select(x.alias("x")).mapInArrow(multiply, _STRIPS)
    shares = strips.repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt").mapInArrow(add, _STRIPS)
    one = shares.withColumn("salt", F.lit(0)).repartition("a", "b").sortWithinPartitions("a", "b")
    return one.mapInArrow(finish, "f1 long, f2 long, r double")


def ranked(rows: DataFrame, key: str, features: str = "features") -> DataFrame:
    """key and features as ranks within each feature, ties sharing their mean rank: pairs() of these are Spearman's.

    Values are counted, sorted by ranges of feature and value, and numbered within each range after the counts of the ranges
    before; so a feature's values are spread over tasks, and a value that most rows share is one row there. Keys are unique.
    """
    long = rows.select(key, F.posexplode(features).alias("idx", "x")).withColumn("x", F.col("x").cast("double") + 0.0)
    counts = long.groupBy("idx", "x").agg(F.count("*").alias("n"))
    ranges = stored(counts.repartitionByRange("idx", "x").withColumn("part", F.spark_partition_id()), "ranks")
    of_range = ranges.groupBy("idx", "part").agg(F.sum("n").alias("total"))  # two at most for each range, beyond one for each feature
    before = of_range.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy("idx").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    within = F.sum("n").over(Window.partitionBy("idx", "part").orderBy("x"))
    ranks = ranges.withColumn("upto", within).join(before, ["idx", "part"]).select("idx", "x", (F.col("before") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    back = long.join(ranks, ["idx", "x"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "rank"))).alias("__r"))  # a row's features
    return back.select(key, F.transform("__r", lambda r: r["rank"]).alias(features))
