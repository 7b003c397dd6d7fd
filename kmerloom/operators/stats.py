"""Quality control of feature tables. Features are one array a row; a statistic takes one pass over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Profiling
from ..functions.sequences import normalized
from .clean import first_wins


def dataset_summary(rows: DataFrame, n_features: int, label: str = "genus", length: str = "sequence_length") -> DataFrame:
    """metric and value, a row each."""
    one = rows.agg(F.count("*").cast("double").alias("rows"), F.count_distinct(label).cast("double").alias("genera"), F.lit(float(n_features)).alias("features"), F.avg(length).alias("mean_length"), F.min(length).cast("double").alias("min_length"), F.max(length).cast("double").alias("max_length"))
    return one.unpivot([], one.columns, "metric", "value")


def missing_values(rows: DataFrame) -> DataFrame:
    """column_name and missing of the columns that miss any; NaN counts as missing."""
    floats = {c for c, t in rows.dtypes if t in ("double", "float")}
    one = rows.agg(*(F.count_if(F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()).alias(c) for c in rows.columns))
    return one.unpivot([], one.columns, "column_name", "missing").filter("missing > 0")


def class_distribution(rows: DataFrame, label: str = "genus") -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def imbalance(rows: DataFrame, label: str = "genus") -> DataFrame:
    """Largest over smallest class, and a verdict: over ten is high, over five moderate."""
    both = class_distribution(rows, label).agg(F.max("n").alias("largest"), F.min("n").alias("smallest"))
    ratio = F.col("largest") / F.col("smallest")
    return both.withColumn("ratio", ratio).withColumn("verdict", F.when(ratio > 10, "high").when(ratio > 5, "moderate").otherwise("balanced"))


def duplicate_ids(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Every row of a key but the first."""
    return first_wins(rows, [key], [order])


def duplicate_features(rows: DataFrame, order: str, features: str = "features") -> DataFrame:
    """Rows whose features an earlier row has. The split is no feature: twins in different splits are found too."""
    first = rows.groupBy(F.xxhash64(features).alias("__h"), F.col(features).alias("__f")).agg(F.min(order).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    return rows.join(first, (F.xxhash64(features) == F.col("__h")) & (F.col(features) == F.col("__f"))).filter(F.col(order) > F.col("__first")).drop("__h", "__f", "__first", "__n")


def feature_statistics(rows: DataFrame, features: str = "features") -> DataFrame:
    """idx, rows, mean, std, variance (both of samples), minimum, maximum, fraction_zero of each feature."""
    x = rows.select(F.posexplode(features).alias("idx", "x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(F.col("idx").cast("long").alias("idx")).agg(F.count("x").alias("rows"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("variance"), F.min("x").alias("minimum"), F.max("x").alias("maximum"), F.avg((F.col("x") == 0).cast("double")).alias("fraction_zero"))


def sparse_statistics(long: DataFrame, n: int, index: str = "kmer_idx", value: str = "freq") -> DataFrame:
    """The same from the long form, where zeros have no rows. n: sequences."""
    s = long.groupBy(F.col(index).alias("idx")).agg(F.count("*").alias("nnz"), F.sum(value).alias("s"), F.sum(F.col(value) ** 2).alias("ss"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    some_zero = F.col("nnz") < n
    variance = F.try_divide(F.col("ss") - F.col("s") ** 2 / n, F.lit(float(n - 1)))
    return s.select("idx", (F.col("s") / n).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"), F.greatest(variance, F.lit(0.0)).alias("variance"), F.when(some_zero, F.least(F.lit(0.0), "lo")).otherwise(F.col("lo")).alias("minimum"), F.when(some_zero, F.greatest(F.lit(0.0), "hi")).otherwise(F.col("hi")).alias("maximum"), (1 - F.col("nnz") / n).alias("fraction_zero"))


def constant_features(statistics: DataFrame) -> DataFrame:
    return statistics.filter("minimum = maximum").select("idx")


def near_zero_variance(statistics: DataFrame, below: float = Profiling.near_zero_variance) -> DataFrame:
    return statistics.filter(F.col("variance") < below).select("idx", "variance")


def sparse_features(statistics: DataFrame, least: float = Profiling.sparse_fraction) -> DataFrame:
    return statistics.filter(F.col("fraction_zero") >= least).select("idx", "fraction_zero")


def top_variance(statistics: DataFrame, n: int) -> DataFrame:
    return statistics.orderBy(F.desc("variance"), "idx").limit(n).select("idx", "variance")


def row_sums(rows: DataFrame, features: str = "features") -> DataFrame:
    """The range of the rows' sums."""
    total = F.aggregate(F.transform(features, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return rows.agg(F.min(total).alias("min_sum"), F.max(total).alias("max_sum"))


def normalized_variance(rows: DataFrame, features: str = "features") -> DataFrame:
    """Variances of features after each row is divided by its sum."""
    as_doubles = F.transform(features, lambda x: x.cast("double"))
    return feature_statistics(rows.select(normalized(as_doubles).alias("features"))).select("idx", "variance")


def report(statistics: DataFrame, n_correlated: int, p: Profiling = Profiling()) -> DataFrame:  # noqa: B008
    """line_no and line of the recommendations. "No major" looks at features one by one, not at correlated pairs."""
    one = statistics.agg(F.count_if(F.col("minimum") == F.col("maximum")).alias("constant"), F.count_if(F.col("variance") < p.near_zero_variance).alias("flat"), F.count_if(F.col("fraction_zero") >= p.sparse_fraction).alias("sparse")).first()
    lines = [f"{n} {what}" for n, what in ((one["constant"], "constant features: remove them"), (one["flat"], "features of near-zero variance: consider removing them"), (one["sparse"], "sparse features: consider a smaller k"), (n_correlated, "highly correlated pairs: consider reducing them")) if n]
    if not (one["constant"] or one["flat"] or one["sparse"]):
        lines.append("No major recommendations")
    return statistics.sparkSession.createDataFrame(list(enumerate(lines)), "line_no long, line string")


def summary_text(summary: DataFrame, classes: DataFrame, title: str = "DATASET DIAGNOSTIC REPORT") -> DataFrame:
    """line_no and line of a short report: the dataset's metrics by name, the imbalance ratio and the number of genera. classes: n of each."""
    metrics = summary.select(F.lit(1).alias("part"), "metric", F.concat_ws(": ", "metric", F.format_string("%.2f", "value")).alias("line"))
    ratio = classes.agg(F.array(F.struct(F.lit(2).alias("part"), F.lit("a").alias("metric"), F.concat(F.lit("Imbalance ratio: "), F.format_string("%.2f", F.max("n") / F.min("n"))).alias("line")), F.struct(F.lit(2).alias("part"), F.lit("b").alias("metric"), F.concat(F.lit("Number of genera: "), F.count("*").cast("string")).alias("line"))).alias("both")).select(F.inline("both"))
    head = summary.sparkSession.createDataFrame([(0, "", title)], "part int, metric string, line string")
    every = head.unionByName(metrics).unionByName(ratio)
    return every.select((F.row_number().over(Window.orderBy("part", "metric")) - 1).cast("long").alias("line_no"), "line")  # some ten lines
