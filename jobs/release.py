"""Builds a training set's release from a table of records, whole, each time it runs.

    python -m jobs.release SOURCE TARGET [--config jobs/release.toml]

Written below TARGET, each folder overwritten by every run:

- ``records/``: the table's records, as cleaning reads them;
- ``audit/drop_reason=.../``: every record and what became of it: the first rule against its label or sequence,
  ``duplicate``, ``nested`` (in a longer record of its genus, on either strand) or ``pass``;
- ``training/split=.../genus=.../``: the records that pass, with their counts of k-mers in the vocabulary's order; no
  accession is in two splits;
- ``classes/``: records and accessions of each genus and split, as JSON.

A run that was broken off leaves at most some of the folders of an earlier run, and the next one writes all of them;
the same table gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import clean, kmers, split

from .records import Settings, log, main, reader, records

AUDIT = "seq_idx long, genus string, accession string, header string, sequence string, drop_reason string"
TRAINING = "seq_idx long, accession string, sequence_length long, kmers array<int>, split string, genus string"


def build(spark: SparkSession, source: str, target: str, s: Settings = Settings()) -> None:  # noqa: B008
    """The job. Each folder is made from the one before, read back, so that no plan holds the whole of it."""
    # stored first: cleaning reads the records several times, and their expressions may be costly
    records(reader(spark, s).load(source), s.columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{target}/records")
    rows = spark.read.schema(AUDIT.rpartition(",")[0]).parquet(f"{target}/records")
    n, ids = rows.agg(F.count("*"), F.count("seq_idx")).first()
    log.info("read %s: %d records", source, n)
    if ids < n:
        raise ValueError(f"{source}: {n - ids} records have no id")
    if twice := [r[0] for r in rows.groupBy("seq_idx").count().filter("count > 1").limit(5).collect()]:
        raise ValueError(f"{source}: ids of several records: {sorted(twice)}")
    # written by the tasks that join the reasons, each a file for each of the few reasons: another shuffle would move all sequences again
    clean.stages(rows, s.cleaning).write.mode("overwrite").option("compression", "zstd").partitionBy("drop_reason").parquet(f"{target}/audit")
    audit = spark.read.schema(AUDIT).parquet(f"{target}/audit")
    for r in audit.groupBy("drop_reason").count().orderBy("drop_reason").collect():  # as many as there are rules
        log.info("wrote %s/audit: %d records %s", target, r["count"], r["drop_reason"])
    passed = audit.filter("drop_reason = 'pass'")
    counted = passed.select("seq_idx", "accession", F.length("sequence").cast("long").alias("sequence_length"), kmers.counted(F.col("sequence"), s.kmers).alias("kmers"), "genus")  # before the join, which shuffles
    out = counted.join(split.group_split(passed, p=s.splitting), "accession").select("seq_idx", "accession", "sequence_length", "kmers", "split", "genus")
    # a genus with very many records is written by several tasks, small ones share a task
    out.hint("rebalance", "split", "genus").sortWithinPartitions("split", "genus", "seq_idx").write.mode("overwrite").partitionBy("split", "genus").parquet(f"{target}/training")
    training = spark.read.schema(TRAINING).parquet(f"{target}/training")
    classes = training.groupBy("genus", "split").agg(F.count("*").alias("records"), F.count_distinct("accession").alias("accessions"))
    classes.coalesce(1).write.mode("overwrite").json(f"{target}/classes")  # a row for each genus and split
    for r in split.sizes(training).orderBy("split").collect():
        log.info("wrote %s/training: %d records of %d accessions in %s", target, r["rows"], r["groups"], r["split"])


def output(spark: SparkSession, target: str) -> DataFrame:
    """A row for each record of the input: what became of it, and its row of the training set if it passed."""
    audit = spark.read.schema(AUDIT).parquet(f"{target}/audit").select("seq_idx", "genus", "drop_reason")
    training = spark.read.schema(TRAINING).parquet(f"{target}/training").drop("genus")
    return audit.join(training, "seq_idx", "left")


if __name__ == "__main__":
    main(build, "release")
