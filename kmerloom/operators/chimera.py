"""Chimeras without a reference: sequences made of the start of one more abundant sequence and the end of another.

A sequence of n letters is a chimera if for some place l, at least ``least`` letters from both ends, its first l letters
begin one sequence of its genus (and file) and its last n - l letters end another, both at least ``skew`` times as
abundant; letters' case doesn't count, and the two parents have to differ, so that a deletion in one parent is no chimera.

No pairs of sequences are made. What may be a parent's start is a key (length, digest), and of each key only the two
most abundant sequences matter: two are enough to know whether two different parents exist. Keys are taken at multiples
of ``least`` first; a sequence that this neither proves nor rules out asks for all lengths between two multiples, and
only parents that share the multiple before answer. Ends are starts of the reversed sequence. The two of a key are found
by a row number whose limit is applied before the shuffle, so a start that all sequences share sends two rows a task;
the join back has one row a key on one side, and Spark's skew join splits the other.

A null sequence is neither chimera nor parent; nor can one be a chimera that is shorter than two segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import measured_joins, stored

SKEW, LEAST = 2.0, 32


def abundance(header: Column) -> Column:
    """What a header says by ``size=N`` after a semicolon or a space, else 1."""
    return F.greatest(F.coalesce(F.regexp_extract(header, r"(?:^|[;\s])size=(\d+)", 1).try_cast("bigint"), F.lit(1)), F.lit(1))


def _digests(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _two(posts: DataFrame, keys: list[str]) -> DataFrame:
    """tops of each key: its two most abundant sequences, as (size, id); keys of a single sequence tell nothing and are left out."""
    order = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "id")
    best = posts.withColumn("__rank", F.row_number().over(order)).filter("__rank <= 2")
    return best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("__rank", "size", "id"))).alias("tops")).filter(F.size("tops") > 1)


def _answers(asked: DataFrame, posts: DataFrame, keys: list[str], skew: float) -> DataFrame:
    """asked with the ids, one or two, of sequences of its key that are abundant enough; rows without any are gone."""
    fit = F.transform(F.filter("tops", lambda t: t["size"] >= F.col("size") * F.lit(float(skew))), lambda t: t["id"])
    return asked.join(_two(posts, keys), keys).withColumn("ids", fit).filter(F.size("ids") > 0).drop("tops")


def _pair(left: Column, right: Column) -> Column:
    """Two different ids, one of each side, or null."""
    a, b = F.try_element_at(left, F.lit(1)), F.try_element_at(right, F.lit(1))
    pair = lambda x, y: F.struct(x.alias("left"), y.alias("right"))
    first = F.when(a != b, pair(a, b)).when(F.size(right) > 1, pair(a, F.try_element_at(right, F.lit(2)))).when(F.size(left) > 1, pair(F.try_element_at(left, F.lit(2)), b))
    return F.when(a.isNotNull() & b.isNotNull(), first)


def _different(left: Column, right: Column) -> Column:
    """Whether two sides, neither null, have two different ids."""
    return F.size(F.array_union(left, right)) > 1


def _side(side: int) -> Column:
    """length -> ids of a side, from the collected answers."""
    return F.map_from_entries(F.transform(F.filter("found", lambda x: x["side"] == side), lambda x: F.struct(x["l"], x["ids"])))


def _collected(answers: DataFrame, scope: list[str]) -> DataFrame:
    """A row for each sequence that has answers on both sides."""
    by = answers.groupBy(*scope, "id").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.collect_list(F.struct("side", "l", "ids")).alias("found"))
    return by.withColumn("starts", _side(0)).withColumn("ends", _side(1)).drop("found").filter((F.size("starts") > 0) & (F.size("ends") > 0))


def _ids(side: str, length: Column) -> Column:
    return F.try_element_at(F.col(side), length)


def find(records: DataFrame, scope: list[str], skew: float = SKEW, least: int = LEAST) -> DataFrame:
    """scope, seq_idx, break_at, left_idx and right_idx of each chimera: a place to break it at and two parents, by ordinal.

    records: scope, seq_idx (unique in it), sequence and size, its abundance. skew: over 1, so that nothing is its own parent.
    """
    if skew <= 1 or least < 1:
        raise ValueError("skew has to be over 1 and least at least 1")
    with measured_joins(records.sparkSession):
        return _found(records, scope, skew, least)


def _found(records: DataFrame, scope: list[str], skew: float, least: int) -> DataFrame:
    base = records.select(*scope, F.col("seq_idx").alias("id"), F.col("size").cast("bigint").alias("size"), F.upper("sequence").alias("s")).filter(F.length("s") >= least).withColumn("n", F.length("s"))
    turned = base.withColumn("t", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("s").alias("text")), F.struct(F.lit(1).alias("side"), F.reverse("s").alias("text"))))).select(*scope, "id", "size", "n", F.col("t.side").alias("side"), F.col("t.text").alias("text"))
    keys = [*scope, "side", "l", "h1", "h2"]

    def starts(df: DataFrame) -> DataFrame:
        return df.select("*", *_digests(F.substring(F.col("text"), F.lit(1), F.col("l")))).drop("text")

    def floor(c: Column) -> Column:
        return c - c % least

    grid = turned.withColumn("l", F.explode(F.sequence(F.lit(least), F.col("n"), F.lit(least))))
    coarse = starts(grid)
    met = _collected(_answers(coarse.filter(F.col("l") <= F.col("n") - least), coarse, keys, skew), scope).filter(F.col("n") >= 2 * least)
    # Between two multiples the one before is the most that can hold and the one after the least; places that can hold at all are looked at.
    longest, from_end = (F.array_max(F.map_keys(c)) + (least - 1) for c in ("starts", "ends"))
    met = met.withColumn("last", F.least(longest, F.col("n") - least)).withColumn("first", F.greatest(F.col("n") - from_end, F.lit(least))).filter("first <= last")
    places = F.filter(F.sequence("first", "last"), lambda x: _different(_ids("starts", floor(x)), _ids("ends", floor(F.col("n") - x))))
    after = lambda x: floor(x + (least - 1))
    sure = F.filter("places", lambda x: _different(_ids("starts", after(x)), _ids("ends", after(F.col("n") - x))))
    judged = stored(met.withColumn("places", places).filter(F.size("places") > 0).withColumn("sure", sure), "chimeras")

    def told(df: DataFrame, at: Column, left: Column, right: Column) -> DataFrame:
        pair = _pair(left, right)
        return df.select(*scope, F.col("id").alias("seq_idx"), at.cast("long").alias("break_at"), pair["left"].alias("left_idx"), pair["right"].alias("right_idx"))

    x = F.col("sure")[0]
    proven = told(judged.filter(F.size("sure") > 0), x, _ids("starts", after(x)), _ids("ends", after(F.col("n") - x)))
    open_ = judged.filter(F.size("sure") == 0).select(*scope, "id", "places")
    asked = turned.join(open_, [*scope, "id"]).withColumn("x", F.explode("places")).drop("places").withColumn("l", F.when(F.col("side") == 0, F.col("x")).otherwise(F.col("n") - F.col("x"))).withColumn("f", floor(F.col("l")))
    wanted = asked.select(*scope, "side", F.col("f").alias("l"), *_digests(F.substring(F.col("text"), F.lit(1), F.col("f")))).distinct()
    near = grid.select("*", *_digests(F.substring(F.col("text"), F.lit(1), F.col("l")))).join(wanted, keys, "left_semi").drop("h1", "h2")
    fine = starts(near.withColumn("l", F.explode(F.sequence(F.col("l"), F.least(F.col("l") + (least - 1), F.col("n"))))))
    settled = _collected(_answers(starts(asked.drop("x", "f")), fine, keys, skew), scope)
    settled = settled.withColumn("sure", F.filter(F.sequence(F.lit(least), F.col("n") - least), lambda p: _different(_ids("starts", p), _ids("ends", F.col("n") - p)))).filter(F.size("sure") > 0)
    return stored(proven.unionByName(told(settled, x, _ids("starts", x), _ids("ends", F.col("n") - x))), "chimeras-found")
