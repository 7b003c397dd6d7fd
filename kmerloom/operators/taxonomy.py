"""The metadata table of a collection, and its joins with feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taxonomy_table(records: DataFrame) -> DataFrame:
    """sequence_id, genus, accession, header, sequence_length."""
    return records.select("sequence_id", "genus", "accession", "header", F.length("sequence").cast("long").alias("sequence_length"))


def inner_merge(features: DataFrame, taxonomy: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Rows that both sides have; extra columns of the taxonomy that clash are left out."""
    return features.join(taxonomy.select(key, *(c for c in taxonomy.columns if c not in features.columns)), key, "inner")


def left_merge(features: DataFrame, taxonomy: DataFrame, key: str = "sequence_id") -> DataFrame:
    return features.join(taxonomy.select(key, *(c for c in taxonomy.columns if c not in features.columns)), key, "left")


def unmatched(features: DataFrame, taxonomy: DataFrame, key: str = "sequence_id") -> DataFrame:
    return features.join(taxonomy.select(key), key, "left_anti").select(key)


def merge_manifest(features: DataFrame, manifest: DataFrame, key: str = "sequence_id") -> DataFrame:
    """Features with their split; an error if a row has several or none, since rows may neither multiply nor lose their split."""
    twice = manifest.groupBy(key).count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"the manifest has several rows of {[r[0] for r in twice.orderBy(key).limit(5).collect()]}")
    joined = features.join(manifest.select(key, "split"), key, "left")
    if not (missing := joined.filter("split is null")).isEmpty():
        raise ValueError(f"no split for {[r[0] for r in missing.select(key).orderBy(key).limit(5).collect()]}")
    return joined
