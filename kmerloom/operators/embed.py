"""Scaling and embeddings of feature arrays."""

from __future__ import annotations

from math import sqrt

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.stored import stored
from . import layout, tsne as tsne_layout
from .stats import feature_statistics

#: Rows that t-SNE lays out on the driver before it places the others; epochs of UMAP.
LANDMARKS, EPOCHS = 1000, 30


def standardize(rows: DataFrame, features: str = "features", population: bool = True) -> DataFrame:
    """Mean 0 and variance 1 for each feature, over all rows; constant features become 0.

    population: the standard deviation of all rows; else of a sample. Statistics are one row of arrays.
    """
    s = feature_statistics(rows, features).agg(F.array_sort(F.collect_list(F.struct("idx", "mean", "std", "rows"))).alias("s"))  # one entry a feature
    spread = lambda x: x["std"] * F.sqrt((x["rows"] - 1) / x["rows"]) if population else x["std"]
    scaled = F.zip_with(F.col(features), F.col("s"), lambda x, m: F.when(spread(m) > 0, (x.cast("double") - m["mean"]) / spread(m)).otherwise(0.0))
    return rows.crossJoin(F.broadcast(s)).withColumn(features, scaled).drop("s")


def pca(rows: DataFrame, k: int = 2, features: str = "features", prefix: str = "PC") -> tuple[DataFrame, list[float]]:
    """Scores PC1 ... PCk of centred features and the variance ratios; the sign of each component makes its largest loading positive."""
    v = rows.withColumn("__v", array_to_vector(F.transform(features, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__pc").fit(v)
    loadings = model.pc.toArray()
    signs = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in loadings.T]
    scores = model.transform(v).withColumn("__pc", vector_to_array("__pc"))
    return scores.select(*rows.columns, *((F.col("__pc")[i] * signs[i]).alias(f"{prefix}{i + 1}") for i in range(k))), model.explainedVariance.toArray().tolist()


def ellipses(scores: DataFrame, label: str = "genus", x: str = "PC1", y: str = "PC2") -> DataFrame:
    """Mean and covariance of each class: what a 95 % ellipse is drawn from."""
    return scores.groupBy(label).agg(F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.var_samp(x).alias("var_x"), F.var_samp(y).alias("var_y"), F.covar_samp(x, y).alias("cov_xy"), F.count("*").alias("n"))


def perplexity(wanted: float, n: int) -> float:
    """What t-SNE may use for n rows."""
    return min(wanted, max(5, (n - 1) // 3))


def neighbours(wanted: int, n: int) -> int:
    """What UMAP may use for n rows."""
    return min(wanted, max(2, n - 1))


def tsne(rows: DataFrame, wanted: float = 30, seed: int = 42, features: str = "features", key: str = "sequence_id", rounds: int = 300, landmarks: int = LANDMARKS, moves: int = tsne_layout.MOVES) -> DataFrame:
    """key, TSNE1, TSNE2 of all rows. Keys are unique.

    Landmarks, those rows whose keys hash smallest, get an exact layout in so many rounds; each other row starts at the mean
    of its nearest landmarks' places, and then all rows move together. Where all rows are landmarks, their layout is the
    result.
    """
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("id"), F.col(key), F.transform(features, lambda x: x.cast("double")).alias("x")), "tsne-rows")
    n = numbered.count()
    if n < 3:
        return numbered.select(key, F.lit(0.0).alias("TSNE1"), F.lit(0.0).alias("TSNE2"))
    chosen = [tuple(r) for r in numbered.orderBy(F.xxhash64(key), key).limit(landmarks).select("id", "x").collect()]
    places = tsne_layout.exact([x for _, x in chosen], perplexity(wanted, len(chosen)), rounds, seed)
    where = tsne_layout.placed(numbered, [x for _, x in chosen], places)
    if n > len(chosen):
        near = layout.neighbours(numbered.select("id", "x"), neighbours(tsne_layout.NEAR, n))
        where = tsne_layout.moved(where, tsne_layout.affinities(near, n, perplexity(wanted, n)), n, moves)
    return numbered.select("id", key).join(where, "id").select(key, F.col("u").alias("TSNE1"), F.col("v").alias("TSNE2"))


def umap(rows: DataFrame, wanted: int = 15, min_dist: float = 0.1, seed: int = 42, features: str = "features", key: str = "sequence_id", epochs: int = EPOCHS) -> DataFrame:
    """key, UMAP1, UMAP2 of all rows; they start from the first two principal components. Keys are unique."""
    numbered = stored(rows.select(F.monotonically_increasing_id().alias("id"), F.col(key), F.transform(features, lambda x: x.cast("double")).alias("x")), "umap-rows")
    n = numbered.count()
    if n < 3:
        return numbered.select(key, F.lit(0.0).alias("UMAP1"), F.lit(0.0).alias("UMAP2"))
    k = neighbours(wanted, n)
    near = layout.neighbours(numbered.select("id", "x"), k)
    scores, _ = pca(numbered.select("id", "x"), features="x")
    wide = scores.agg(F.greatest(F.max(F.abs("PC1")), F.max(F.abs("PC2")))).first()[0] or 1.0
    start = scores.select("id", (F.col("PC1") * (10 / wide)).alias("u"), (F.col("PC2") * (10 / wide)).alias("v"))
    where = layout.spread_out(layout.fuzzy_edges(near, k), start, epochs, min_dist, seed)
    return numbered.select("id", key).join(where, "id").select(key, F.col("u").alias("UMAP1"), F.col("v").alias("UMAP2"))


def sample_std_factor(n: int) -> float:
    """From a sample's standard deviation to the population's."""
    return sqrt((n - 1) / n)


def label_index(rows: DataFrame, label: str = "genus") -> DataFrame:
    """(label, idx): classes numbered in their order; there are few of them."""
    return rows.select(label).distinct().withColumn("idx", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))
