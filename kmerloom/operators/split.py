"""Splits that no group straddles, checks for leakage, and grouped stratified folds."""

from __future__ import annotations

import warnings
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Splitting

SPLITS = ("train", "val", "test")
#: Groups with less than this share of every class are dealt into folds in so many bundles.
SMALL, BUNDLES = 5e-5, 4096


def check_fractions(test: float, val: float) -> None:
    if not 0 < test < 1:
        raise ValueError(f"test fraction {test} is not between 0 and 1")
    if not 0 < val < 1 - test:
        raise ValueError(f"validation fraction {val} is not between 0 and {1 - test}")


def group_split(rows: DataFrame, group: str = "accession", p: Splitting = Splitting()) -> DataFrame:  # noqa: B008
    """group and split. Fractions count groups. Groups are ordered by a hash, so row order doesn't matter.

    Ranks come from the number of smaller hashes per hash prefix, so no task sorts all groups: prefixes
    are counted first, and only groups within one prefix are ranked together.
    """
    check_fractions(p.test, p.val)
    groups = rows.select(F.col(group).alias("g")).distinct().withColumn("h", F.md5(F.concat(F.col("g").cast("string"), F.lit(f":{p.seed}"))))
    groups = groups.withColumn("prefix", F.substring("h", 1, 3))
    sizes = groups.groupBy("prefix").agg(F.count("*").alias("c")).orderBy("prefix").collect()
    n = sum(r["c"] for r in sizes)
    n_test = ceil(p.test * n)
    n_val = ceil(p.val / (1 - p.test) * (n - n_test))
    if n_test == 0 or n_val == 0 or n - n_test - n_val <= 0:
        raise ValueError(f"{n} groups are too few for three splits")
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["prefix"], before))
        before += r["c"]
    spark = rows.sparkSession
    rank = F.row_number().over(Window.partitionBy("prefix").orderBy("h", "g")) + F.col("before")
    ranked = groups.join(F.broadcast(spark.createDataFrame(offsets, "prefix string, before long")), "prefix").withColumn("r", rank)  # at most 4,096 prefixes
    return ranked.select(F.col("g").alias(group), F.when(F.col("r") <= n_test, "test").when(F.col("r") <= n_test + n_val, "val").otherwise("train").alias("split"))


def manifest(taxonomy: DataFrame, group: str = "accession", p: Splitting = Splitting()) -> DataFrame:  # noqa: B008
    """sequence_id, accession, genus, split."""
    return taxonomy.join(group_split(taxonomy, group, p), group).select("sequence_id", "accession", "genus", "split")


def leaks(rows: DataFrame, group: str = "accession") -> DataFrame:
    """Groups in more than one split."""
    return rows.groupBy(group).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def check_split(rows: DataFrame, group: str = "accession", label: str = "genus") -> DataFrame:
    """The rows, if their labels are known and no group leaks; classes that a split lacks are warned of."""
    unknown = rows.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select("split").distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown split labels: {[r[0] for r in unknown]}")
    if found := [r[0] for r in leaks(rows, group).orderBy(group).limit(5).collect()]:
        raise ValueError(f"groups in several splits: {found}")
    for r in missing_classes(rows, label).collect():
        warnings.warn(f"class {r[label]} has no rows in {r['split']}", stacklevel=2)
    return rows


def missing_classes(rows: DataFrame, label: str = "genus") -> DataFrame:
    """(label, split) that don't occur."""
    wanted = rows.select(label).distinct().withColumn("split", F.explode(F.array(*map(F.lit, SPLITS))))
    return wanted.join(rows.select(label, "split").distinct(), [label, "split"], "left_anti")


def sizes(rows: DataFrame, group: str = "accession") -> DataFrame:
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct(group).alias("groups"))


def least_groups(rows: DataFrame, label: str = "genus", group: str = "accession") -> DataFrame:
    """Distinct groups per class, and the smallest such number."""
    return rows.groupBy(label).agg(F.count_distinct(group).alias("groups")).agg(F.min("groups").alias("min_groups"))


def group_folds(rows: DataFrame, label: str = "genus", group: str = "accession", folds: int = 5) -> DataFrame | None:
    """group and fold, classes spread evenly; None if a class has fewer than two groups.

    Groups are taken largest first; each goes to the fold where it evens out the classes' counts best.
    A group with less than SMALL of every class's rows can't tip a fold: such groups go by hash into BUNDLES,
    which are dealt like groups. So the driver holds at most 1 / SMALL groups for each class, whatever the input.
    """
    least = least_groups(rows, label, group).first()["min_groups"] or 0
    k = min(folds, least)
    if k < folds:
        warnings.warn(f"{k} folds instead of {folds}: a class has {least} groups", stacklevel=2)
    if k < 2:
        return None
    table = rows.select(F.col(group).alias("g"), F.col(label).alias("c")).groupBy("g", "c").agg(F.count("*").alias("n"))
    totals = {r["c"]: r["n"] for r in table.groupBy("c").agg(F.sum("n").alias("n")).collect()}
    sums = rows.sparkSession.createDataFrame(list(totals.items()), f"t {dict(rows.dtypes)[label]}, total long")
    cells = table.join(F.broadcast(sums), F.col("c").eqNullSafe(F.col("t")))
    bundle = F.when(F.max(F.col("n") / F.col("total")) < SMALL, F.pmod(F.xxhash64("g"), F.lit(BUNDLES)).cast("int"))
    groups = cells.groupBy("g").agg(F.collect_list(F.struct("c", "n")).alias("own"), bundle.alias("bundle"))
    by_group: dict = {(r["g"], None): {x["c"]: x["n"] for x in r["own"]} for r in groups.filter("bundle is null").collect()}
    small = groups.filter("bundle is not null")
    for r in small.select("bundle", F.explode("own").alias("x")).groupBy("bundle", "x.c").agg(F.sum("x.n").alias("n")).collect():
        by_group.setdefault((None, r["bundle"]), {})[r["c"]] = r["n"]
    held = [dict.fromkeys(totals, 0) for _ in range(k)]
    assigned = []
    for g, own in sorted(by_group.items(), key=lambda x: (-sum(x[1].values()), str(x[0][0]), x[0][1] or 0)):
        own = dict(sorted(own.items(), key=lambda x: str(x[0])))
        cost = [sum((held[f][c] + n) ** 2 - held[f][c] ** 2 for c, n in ((c, n / totals[c]) for c, n in own.items())) for f in range(k)]
        best = min(range(k), key=lambda f: (cost[f], sum(held[f].values()), f))
        for c, n in own.items():
            held[best][c] += n / totals[c]
        assigned.append((g, best))
    kind = dict(rows.dtypes)[group]
    out = rows.sparkSession.createDataFrame([(g, f) for (g, b), f in assigned if b is None], f"{group} {kind}, fold int")
    if bundles := [(b, f) for (_, b), f in assigned if b is not None]:
        dealt = small.join(F.broadcast(rows.sparkSession.createDataFrame(bundles, "bundle int, fold int")), "bundle")
        out = out.unionByName(dealt.select(F.col("g").alias(group), "fold"))
    return out
