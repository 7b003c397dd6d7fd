"""From raw documents to training tokens, in five stages.

Each stage gets what its predecessor kept, as a table read back from Parquet, and its decisions take effect:
documents that fail the quality rules go, repeated lines go, one document of each group of near duplicates
stays, documents with a benchmark passage go, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from kmerloom.llm.common import keep, table
from kmerloom.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.clean_text(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of the text decoded from them."""
    return bpe.digests(docs, tokenizer_path(), with_ids=True)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_deduplication), ("near_dedup", near_deduplication), ("decontamination", decontamination), ("bpe_encoding", bpe_encoding)]

#: SQL has no boosted trees and no tokenizer; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
