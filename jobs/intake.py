"""Takes in records as their files arrive, and keeps each genus's k-mer profile up to date.

    python -m jobs.intake SOURCE TARGET [--config jobs/intake.toml]

A file stream with a checkpoint (``TARGET/checkpoint``) takes only files that no earlier run has taken, then stops. SOURCE is a folder
or a glob; a single file has to be written as a glob, ``/data/{one.parquet}``.
Each batch writes, below TARGET:

- ``records/batch_id=.../``: its records as they came, and what the rules say of each;
- ``keys/batch_id=.../``: a digest of each sequence that it admits, which later batches are held against;
- ``decisions/batch_id=.../decision=.../``: its records, each ``admitted``, or with the first rule against its label or
  sequence, ``no_id``, or ``duplicate``: of equal sequences of a genus the first batch's stays, within a batch the
  smallest id's. Rows of a batch that agree in id and sequence share a decision;
- ``counts/batch_id=.../``: k-mer counts by genus of what it admits.

A batch that runs again overwrites its own partitions and looks at earlier batches only, so it comes to the same result.
At the end ``profile/genus=.../`` is written anew from all batches' counts: k-mers, their counts and shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kmerloom.operators import clean, kmers

from .records import Settings, log, main, reader, records

RECORDS = "seq_idx long, genus string, accession string, header string, sequence string, drop_reason string, key string, batch_id long"
KEYS = "key string, first long, batch_id long"
DECISIONS = "seq_idx long, genus string, accession string, sequence_length long, batch_id long, decision string"
COUNTS = "genus string, kmer string, n long, batch_id long"
PROFILE = "kmer string, n long, share double, genus string"


def take(batch: DataFrame, batch_id: int, target: str, s: Settings) -> None:
    """One batch: decides, and writes what it has decided."""
    spark, number = batch.sparkSession, F.lit(batch_id).cast("long").alias("batch_id")

    def store(df: DataFrame, name: str, schema: str, *partitions: str) -> DataFrame:
        """Overwrites this batch's partitions of a folder, no others, and reads them back."""
        df.select("*", number).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *partitions).parquet(f"{target}/{name}")
        return spark.read.schema(schema).parquet(f"{target}/{name}").filter(F.col("batch_id") == batch_id).drop("batch_id")

    judged = clean.with_reason(records(batch, s.columns), s.cleaning)
    judged = judged.withColumn("drop_reason", F.when(F.col("seq_idx").isNull(), "no_id").otherwise(F.col("drop_reason")))
    judged = store(judged.withColumn("key", F.sha2(F.concat(F.coalesce("genus", F.lit("")), F.lit("\0"), F.upper("sequence")), 256)), "records", RECORDS)
    log.info("batch %d: read %d records", batch_id, judged.count())
    first = judged.filter("drop_reason = 'pass'").groupBy("key").agg(F.min("seq_idx").alias("first"))  # copies are combined before the shuffle
    earlier = spark.read.schema(KEYS).parquet(f"{target}/keys").filter(F.col("batch_id") < batch_id)
    # what is old is on the side that streams by, so that with a small batch it is scanned and not shuffled
    first = first.join(earlier.select("key").join(first.select("key"), "key", "left_semi"), "key", "left_anti")
    fresh = store(first, "keys", KEYS)
    decision = F.when(F.col("drop_reason") != "pass", F.col("drop_reason")).when(F.col("seq_idx") == F.col("first"), "admitted").otherwise("duplicate")
    decided = judged.join(fresh, "key", "left").withColumn("decision", decision)
    decisions = store(decided.select("seq_idx", "genus", "accession", F.length("sequence").cast("long").alias("sequence_length"), "decision"), "decisions", DECISIONS, "decision")
    admitted = judged.join(fresh, (judged["key"] == fresh["key"]) & (judged["seq_idx"] == fresh["first"]), "left_semi")
    store(kmers.counts(admitted, "genus", s.kmers), "counts", COUNTS)
    for r in decisions.groupBy("decision").count().orderBy("decision").collect():  # as many as there are rules
        log.info("batch %d: wrote %d records %s", batch_id, r["count"], r["decision"])


def publish(spark: SparkSession, target: str) -> None:
    """The profile of each genus, from all batches' counts: a row for each genus, k-mer and batch is read, no record."""
    n = spark.read.schema(COUNTS).parquet(f"{target}/counts").groupBy("genus", "kmer").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("genus"))  # at most as many rows as there are k-mers
    n.select("kmer", "n", share.alias("share"), "genus").sortWithinPartitions("genus", "kmer").write.mode("overwrite").partitionBy("genus").parquet(f"{target}/profile")
    log.info("wrote %s/profile: %d rows", target, spark.read.schema(PROFILE).parquet(f"{target}/profile").count())


def run(spark: SparkSession, source: str, target: str, s: Settings = Settings()) -> None:  # noqa: B008
    """The job: takes all files that are new, waits for the stream to end, and publishes."""
    for name, columns in (("keys", KEYS), ("decisions", DECISIONS), ("counts", COUNTS)):  # nothing is added; the folders are there even if no file ever comes
        spark.createDataFrame([], columns).write.mode("append").partitionBy("batch_id").parquet(f"{target}/{name}")
    schema = s.schema or reader(spark, s).load(source).schema
    stream = spark.readStream.format(s.format).options(**s.options).schema(schema)
    if s.files_at_once:
        stream = stream.option("maxFilesPerTrigger", s.files_at_once)
    query = stream.load(source).writeStream.foreachBatch(lambda df, i: take(df, i, target, s)).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in query.recentProgress)
    log.info("took %d batches from %s", batches, source)
    publish(spark, target)


def output(spark: SparkSession, target: str) -> DataFrame:
    """All decisions and all profiles in one table: what (record or kmer), genus, name, decision, n (bases, or k-mers) and share."""
    d = spark.read.schema(DECISIONS).parquet(f"{target}/decisions")
    p = spark.read.schema(PROFILE).parquet(f"{target}/profile")
    none = F.lit(None)
    return d.select(F.lit("record").alias("what"), "genus", F.col("seq_idx").cast("string").alias("name"), "decision", F.col("sequence_length").alias("n"), none.cast("double").alias("share")).unionByName(p.select(F.lit("kmer").alias("what"), "genus", F.col("kmer").alias("name"), none.cast("string").alias("decision"), "n", "share"))


if __name__ == "__main__":
    main(run, "intake")
