"""The four entry points, from tables to tables, in stages that are stored; and all of them in a row.

Every entry point takes ``stages``: given the same ones, a later call skips the stages that are there already.
"""

from __future__ import annotations

import warnings
from dataclasses import asdict, dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Boosting, Cleaning, Forest, Kmers, Profiling, Reducing, Splitting
from ..operators import blocks, clean, correlation, embed, evaluate, explain, kmers, models, split, stats, taxonomy
from ..sources import fasta
from .stages import Stages


def clean_folder(spark: SparkSession, folder: str, out: str | None = None, c: Cleaning = Cleaning(), chimeras: clean.ChimeraFilter | None = None, compat: bool = False, intermediates: bool = False, stages: Stages | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """Raw FASTA folder to cleaned records and a summary by file.

    chimeras: a step of one's own in place of the one that c names.
    out: gets ``<genus>.clean.fa``, the summary as CSV and, if asked, each stage's records in folders of their own.
    """
    st, chimeras = stages or Stages(spark), chimeras or clean.chimera_filter(c)
    read = fasta.read_split(spark, folder, compat)
    source = st.files(folder, "*.{fasta,fa}")
    staged = st.table("cleaned", lambda: clean.stages(read, c), folder, source, c, compat)
    ended = cache(lambda: clean.summarized(staged, chimeras))
    records = st.table("records", lambda: ended()[0], staged, chimeras.__qualname__)
    summary = st.table("cleaning_summary", lambda: ended()[1], staged, chimeras.__qualname__)
    if out:
        fasta.write_files(records, out)
        summary.write.csv(f"{out}/cleaning_summary", header=True, mode="overwrite")
        for i, stage in enumerate(clean.STAGES if intermediates else (), 1):
            fasta.write_folder(clean.in_stage(staged, stage), f"{out}/_intermediate/{i}_{stage}")
        if intermediates:
            fasta.write_folder(records, f"{out}/_intermediate/4_final_clean")
    return records, summary


@dataclass
class Features:
    taxonomy: DataFrame
    matrix: DataFrame
    manifest: DataFrame
    reduced: DataFrame
    kept: list[str]
    dropped: DataFrame


def build_features(records: DataFrame, k: Kmers = Kmers(), s: Splitting = Splitting(), r: Reducing = Reducing(), stages: Stages | None = None) -> Features:  # noqa: B008
    """Cleaned records to metadata, k-mer matrix, split and the matrix reduced by what training rows say."""
    spark, st = records.sparkSession, stages or Stages(records.sparkSession)
    labelled = st.table("labelled", lambda: fasta.labelled(records), records)
    if labelled.isEmpty():
        raise ValueError("no records")
    if twice := fasta.duplicated_ids(labelled).orderBy("sequence_id").limit(5).collect():
        warnings.warn(f"sequence ids of several records: {[x[0] for x in twice]}", stacklevel=2)
    meta = st.table("taxonomy", lambda: taxonomy.taxonomy_table(labelled), labelled)
    matrix = st.table("matrix", lambda: kmers.matrix(labelled, "sequence_id", k, "genus"), labelled, k)
    if lost := labelled.count() - matrix.count():
        warnings.warn(f"{lost} sequences have no valid k-mer and no row in the matrix", stacklevel=2)
    manifest = st.table("manifest", lambda: split.manifest(meta, p=s), meta, s)
    joined = st.table("joined", lambda: taxonomy.merge_manifest(matrix, manifest), matrix, manifest)

    def reduction() -> DataFrame:
        """A row for each feature that is kept or dropped for another; features that don't vary have none."""
        _, kept, log = correlation.reduce_features(joined, r)
        return spark.createDataFrame([(i, None, None) for i in kept] + [(d, x, c) for d, x, c in log], "feature int, for int, correlation double").coalesce(1)

    decided = st.table("reduction", reduction, joined, r).collect()  # a row for each feature
    kept = sorted(x["feature"] for x in decided if x["for"] is None)
    reduced = st.table("reduced", lambda: correlation.take(joined, kept), joined, kept)
    names = [x["kmer"] for x in kmers.vocabulary(spark, k).orderBy("kmer_idx").collect()]  # 4^k of them
    dropped = spark.createDataFrame([(names[x["feature"]], names[x["for"]], x["correlation"]) for x in decided if x["for"] is not None], "dropped_feature string, kept_feature string, correlation double")
    return Features(meta, matrix, manifest, reduced, [names[i] for i in kept], dropped)


def embeddings(matrix: DataFrame, label: str = "genus", epochs: int = embed.EPOCHS) -> dict[str, DataFrame]:
    """Scaled matrix and its two-dimensional pictures; nothing for fewer than two classes."""
    if matrix.select(label).distinct().limit(2).count() < 2:
        return {}
    scaled = embed.standardize(matrix)
    scores, _ = embed.pca(scaled)
    return {"scaled": scaled, "pca": scores, "tsne": embed.tsne(scaled), "umap": embed.umap(scaled, epochs=epochs)}


@dataclass
class Trained:
    model: object
    cv: DataFrame | None
    validation: DataFrame
    test: DataFrame
    summary: dict
    roc: DataFrame
    importance: list[tuple[str, float]]
    shap: DataFrame | None


def train_and_evaluate(features: DataFrame, meta: DataFrame, names: list[str], model: str = "random_forest", cross_validate: bool = True, forest: Forest = Forest(), boosting: Boosting = Boosting(), s: Splitting = Splitting(), stages: Stages | None = None) -> Trained:  # noqa: B008
    """Reduced matrix and metadata to a model, its reports and its attributions. Without a split in the matrix one is made.

    The summary is stored as ``metrics_<model>.json`` among the stages.
    """
    if model not in models.MODELS:
        raise ValueError(f"unknown model {model}: one of {', '.join(models.MODELS)}")
    st = stages or Stages(features.sparkSession)
    joined = st.table("merged", lambda: taxonomy.inner_merge(features, meta), features, meta)
    n, before = joined.count(), features.count()
    if not n:
        raise ValueError("no sequence is in both tables")
    if n < before:
        warnings.warn(f"{before - n} rows have no metadata", stacklevel=2)
    if not joined.filter(F.exists("features", lambda x: x.isNull() | F.isnan(x))).isEmpty():
        raise ValueError("features have missing values")
    if "split" not in joined.columns:
        warnings.warn("no split in the matrix: one is made", stacklevel=2)
        whole = joined
        joined = st.table("split", lambda: whole.join(split.group_split(whole, p=s), "accession"), whole, s)
    rows = st.table("prepared", lambda: models.prepare(split.check_split(joined)), joined)
    train, val, test = (rows.filter(F.col("split") == x) for x in ("train", "val", "test"))
    p = forest if model == "random_forest" else boosting
    given = {"forest": forest} if model == "random_forest" else {"boosting": boosting}
    empty = rows.sparkSession.createDataFrame([], "fold int, score double")
    cv = st.table("cross_validation", lambda: empty if (found := models.cross_validate(model, train, folds=s.folds, **given)) is None else found, rows, model, p, s.folds) if cross_validate else None
    fitted = st.model("model", lambda: models.train(model, train, val, forest, boosting), models.save, lambda path: models.restore(path)[0], rows, model, p)
    predicted = st.table("test_predictions", lambda: models.predict(fitted, test).drop("v"), rows, model, p)
    on_val = st.table("validation_predictions", lambda: models.predict(fitted, val).drop("v"), rows, model, p)
    classes = [float(i) for i in range(rows.select("y").distinct().count())]
    c = st.table("test_confusion", lambda: evaluate.confusion(predicted, labels=classes), predicted)
    on_test = st.table("test_report", lambda: evaluate.report(c), c)
    val_report = st.table("validation_report", lambda: evaluate.report(evaluate.confusion(on_val, labels=classes)), on_val, classes)
    areas = evaluate.auc(evaluate.roc_points(points := evaluate.one_vs_rest(predicted)))
    summary = evaluate.summary(c).first().asDict() | {"macro_auc": evaluate.macro_auc(areas).first()[0], "r2_discrete": evaluate.r2(predicted, "y", "pred").first()[0], "r2_probabilities": evaluate.r2_probabilities(predicted).first()[0], "model": model, "parameters": asdict(p), "n_features": len(names)}
    st.note(f"metrics_{model}", summary)
    shap = st.table("shap", lambda: explain.explain(test, explain.trees_of(rows.sparkSession, fitted), names), rows, model, p, names)
    return Trained(fitted, None if cv is None or cv.isEmpty() else cv, val_report, on_test, summary, evaluate.roc_points(points), models.importances(fitted, names), shap)


def diagnose(features: DataFrame, meta: DataFrame, n_features: int, p: Profiling = Profiling(), stages: Stages | None = None) -> dict[str, DataFrame]:  # noqa: B008
    """All quality-control tables. The split is never a feature."""
    st = stages or Stages(features.sparkSession)
    merged = st.table("described", lambda: taxonomy.left_merge(features, meta).drop("features"), features, meta)
    s = st.table("feature_statistics", lambda: stats.feature_statistics(features), features)
    pairs = st.table("correlated", lambda: blocks.pairs(features, p.correlated), features, p.correlated)
    return {
        "dataset_summary": stats.dataset_summary(merged, n_features),
        "summary_text": stats.summary_text(stats.dataset_summary(merged, n_features), stats.class_distribution(merged)),
        "missing_values": stats.missing_values(merged),
        "class_distribution": stats.class_distribution(merged),
        "imbalance": stats.imbalance(merged),
        "duplicate_sequence_ids": stats.duplicate_ids(merged, "sequence_id", "sequence_id"),
        "duplicate_feature_vectors": stats.duplicate_features(features, "sequence_id"),
        "row_sums": stats.row_sums(features),
        "constant_features": stats.constant_features(s),
        "near_zero_variance": stats.near_zero_variance(s, p.near_zero_variance),
        "sparse_features": stats.sparse_features(s, p.sparse_fraction),
        "feature_statistics": s,
        "highly_correlated_features": pairs,
        "top_variance": stats.top_variance(s, p.heatmap_features),
        "recommendations": stats.report(s, pairs.count(), p),
    }


@dataclass
class Run:
    summary: DataFrame
    features: Features
    trained: dict[str, Trained]
    diagnosis: dict[str, DataFrame]
    stages: list[dict]


def from_folder(spark: SparkSession, folder: str, out: str, c: Cleaning = Cleaning(), k: Kmers = Kmers(), s: Splitting = Splitting(), r: Reducing = Reducing(), forest: Forest = Forest(), boosting: Boosting = Boosting(), p: Profiling = Profiling(), which: tuple[str, ...] = models.MODELS, cross_validate: bool = True) -> Run:  # noqa: B008
    """All entry points in a row, from a FASTA folder to models and diagnosis.

    Stages are kept in ``<out>/stages``, with the metrics of each model and ``run_metadata.json``: the stages, their rows and seconds, and all parameters.
    """
    st = Stages(spark, f"{out.rstrip('/')}/stages")
    records, summary = clean_folder(spark, folder, c=c, stages=st)
    f = build_features(records, k, s, r, st)
    trained = {m: train_and_evaluate(f.reduced, f.taxonomy, f.kept, m, cross_validate, forest, boosting, s, st) for m in which}
    diagnosis = diagnose(f.reduced.drop("split"), f.taxonomy, len(f.kept), p, st)
    st.finish(folder=folder, features=len(f.kept), parameters={"cleaning": asdict(c), "kmers": asdict(k), "splitting": asdict(s), "reducing": asdict(r), "forest": asdict(forest), "boosting": asdict(boosting), "profiling": asdict(p)}, metrics={m: t.summary for m, t in trained.items()})
    return Run(summary, f, trained, diagnosis, st.done)
