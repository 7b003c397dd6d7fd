"""Cleaning as files arrive: the same label, quality and exact-copy rules on a stream of FASTA files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cleaning
from ..operators.clean import with_reason
from ..sources.fasta import stem


def read_stream(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """genus, header, sequence, arrived of the records of files that come into a folder."""
    files = spark.readStream.option("pathGlobFilter", "*.{fasta,fa}").option("maxFilesPerTrigger", files_at_once).text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("arrived"))
    records = files.select(stem(F.col("file")).alias("genus"), "arrived", F.posexplode(F.split("value", r"(?m)^>")).alias("pos", "record")).filter("pos > 0")
    return records.select("genus", "arrived", F.regexp_replace(F.substring_index("record", "\n", 1), r"\s+$", "").alias("header"), F.upper(F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"\s", "")).alias("sequence"))


def clean_stream(records: DataFrame, c: Cleaning = Cleaning(), late: str = "1 day") -> DataFrame:  # noqa: B008
    """Records that pass, each sequence of a genus once within the watermark; which copy stays is the first to arrive."""
    passed = with_reason(records, c).filter("drop_reason = 'pass'").drop("drop_reason")
    return passed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["genus", "sequence"])
