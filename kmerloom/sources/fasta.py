"""FASTA folders as tables and tables as FASTA, CSV and JSON.

``read_split`` reads a file of any size by several tasks and keeps each record's ordinal; the entry points use it.
``read_folder`` reads each file as one text: fine for a file per genus. ``format("fasta")`` is a Python data source
that streams a file in one task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from ..functions import sequences
from .stored import shared_folder, stored  # noqa: F401

SCHEMA = "genus string, file string, seq_idx long, header string, sequence string"
WIDTH = 60


def stem(name: Column, compat: bool = False) -> Column:
    """The file name without its ending; a further ``.clean`` goes too unless compat asks for the plain stem."""
    base = F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)
    return base if compat else F.regexp_replace(base, r"\.clean$", "")


def read_folder(spark: SparkSession, folder: str, compat: bool = False) -> DataFrame:
    """genus, file, seq_idx (within the file), header, sequence of all records in ``*.fasta`` and ``*.fa`` of a folder, not below it.

    Text before the first ``>`` is dropped, blank lines are skipped, a record without lines has an empty
    sequence. A folder without such files is an error.
    """
    files = spark.read.option("pathGlobFilter", "*.{fasta,fa}").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    if files.isEmpty():
        raise FileNotFoundError(f"no .fasta or .fa files in {folder}")
    records = files.select(stem(F.col("file"), compat).alias("genus"), "file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"(?m)^>")).alias("pos", "record")).filter("pos > 0")
    return records.select("genus", "file", (F.col("pos") - 1).cast("long").alias("seq_idx"), *_parsed())


def read_split(spark: SparkSession, folder: str, compat: bool = False) -> DataFrame:
    """The rows of read_folder from files of any size: a file is read by as many tasks as it has splits of ``spark.sql.files.maxPartitionBytes``.

    The text source cuts at a line end before ``>``, wherever a split falls. A record's ordinal is its place among those of its split, in the order
    in which they are read, and the number of records in the splits before, which a first scan counts: a row for each split, summed up file by file.
    One difference: a ``>`` that is the very last letter of a file is no record here, while read_folder makes an empty one of it.
    """
    if spark.read.format("binaryFile").option("pathGlobFilter", "*.{fasta,fa}").load(folder).select("path").isEmpty():
        raise FileNotFoundError(f"no .fasta or .fa files in {folder}")
    lines = spark.read.option("pathGlobFilter", "*.{fasta,fa}").option("lineSep", "\n>").text(folder).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    pieces = lines.select("path", "file", "block", F.explode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n>")).alias("record")).withColumn("id", F.monotonically_increasing_id())
    of_file = Window.partitionBy("path").orderBy("block")
    blocks = pieces.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.min_by(F.startswith("record", F.lit(">")), "id").alias("begins"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(of_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("begins", F.first("begins").over(of_file)).drop("n")
    # What stands before a file's first ">" counts as one piece of the first split; a file that begins with ">" has nothing there.
    numbered = pieces.join(blocks, ["path", "block"]).withColumn("at", F.col("before") + F.col("id") - F.col("first_id")).withColumn("seq_idx", F.col("at") - F.when(F.col("begins"), 0).otherwise(1)).filter("seq_idx >= 0")
    record = F.when(F.col("at") == 0, F.substr("record", F.lit(2))).otherwise(F.col("record"))
    return numbered.withColumn("record", record).select(stem(F.col("file"), compat).alias("genus"), "file", F.col("seq_idx").cast("long").alias("seq_idx"), *_parsed())


def _parsed() -> list[Column]:
    """header and sequence of a record without its ``>``."""
    return [F.regexp_replace(F.substring_index("record", "\n", 1), r"\s+$", "").alias("header"), F.regexp_replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), r"[ \t]*\n|[ \t]+$", "").alias("sequence")]


def labelled(records: DataFrame) -> DataFrame:
    """sequence_id, genus, header, accession, sequence in upper case."""
    return records.select(F.concat_ws("_", "genus", F.col("seq_idx").cast("string")).alias("sequence_id"), "genus", "seq_idx", "header", sequences.accession(F.col("header"), F.col("seq_idx")).alias("accession"), F.upper("sequence").alias("sequence"))


class FastaSource(DataSource):
    """``spark.read.format("fasta").option("paths", "a.fa,b.fa")``: one task a file, records streamed in order."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return FastaReader([p for p in self.options.get("paths", self.options.get("path", "")).split(",") if p])


class FastaReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        from pyarrow import fs

        path = partition.value
        store, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        file = name.rsplit("/", 1)[-1]
        genus = file.rpartition(".")[0].removesuffix(".clean")
        index, header, lines = -1, None, []
        with store.open_input_stream(name) as f:
            rest = b""
            while True:
                block = f.read(1 << 20)
                parts = (rest + block).split(b"\n")
                rest = parts.pop() if block else b""
                for line in (p.decode().rstrip() for p in parts):
                    if line.startswith(">"):
                        if header is not None:
                            yield genus, file, index, header, "".join(lines)
                        index, header, lines = index + 1, line[1:], []
                    elif line:
                        lines.append(line)
                if not block:
                    break
        if header is not None:
            yield genus, file, index, header, "".join(lines)


def as_text(records: DataFrame) -> DataFrame:
    """genus, seq_idx and value: each record as FASTA, its sequence in lines of sixty letters."""
    wrapped = F.rtrim(F.regexp_replace("sequence", f"(.{{{WIDTH}}})", "$1\n"))
    text = F.concat(F.lit(">"), "header", F.when(F.length("sequence") > 0, F.concat(F.lit("\n"), F.regexp_replace(wrapped, r"\n$", ""))).otherwise(""))
    return records.select("genus", "seq_idx", text.alias("value"))


def write_folder(records: DataFrame, folder: str) -> None:
    """A folder ``genus=...`` of FASTA text for each genus, records in order over its files; a large genus is spread over tasks."""
    as_text(records).repartitionByRange("genus", "seq_idx").sortWithinPartitions("genus", "seq_idx").select("genus", "value").write.partitionBy("genus").mode("overwrite").text(folder)


def write_files(records: DataFrame, folder: str, ending: str = ".clean.fa") -> DataFrame:
    """One file ``<genus>.clean.fa`` for each genus, which one task streams; genus, file and records, once they are written.

    A file gets its name once it is whole; until then it has a hidden one of its attempt's, so attempts of a task that run
    side by side don't meet and one that fails leaves no half file for a reader. folder: shared by all executors.
    """

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        attempt, genus, out, told = uuid.uuid4().hex, None, None, []

        def end():
            out.close()
            store.move(f"{root}/_{attempt}-{genus}", f"{root}/{genus}{ending}")

        try:
            for b in batches:
                for g, value in zip(b["genus"].to_pylist(), b["value"].to_pylist(), strict=True):
                    if g != genus or out is None:
                        if out is not None:
                            end()
                        genus, out = g, store.open_output_stream(f"{root}/_{attempt}-{g}")
                        told.append([g, f"{g}{ending}", 0])
                    out.write(value.encode() + b"\n")
                    told[-1][2] += 1
        except BaseException:
            if out is not None:
                out.close()
                store.delete_file(f"{root}/_{attempt}-{genus}")
            raise
        if out is not None:
            end()
        yield pa.RecordBatch.from_pydict({"genus": [t[0] for t in told], "file": [t[1] for t in told], "records": [t[2] for t in told]}, pa.schema([("genus", pa.string()), ("file", pa.string()), ("records", pa.int64())]))

    written = as_text(records).repartition("genus").sortWithinPartitions("genus", "seq_idx").mapInArrow(run, "genus string, file string, records long")
    return records.sparkSession.createDataFrame(written.collect(), written.schema)  # a row for each genus


def duplicated_ids(records: DataFrame) -> DataFrame:
    """Sequence ids that more than one record has: files of one stem, or a genus in two files."""
    return records.groupBy("sequence_id").agg(F.count("*").alias("copies")).filter("copies > 1")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With a given schema: inferring one would read thousands of columns twice."""
    return spark.read.csv(path, header=True, schema=schema)


def write_wide_csv(features: DataFrame, names: list[str], path: str, metadata: tuple[str, ...] = ("sequence_id", "genus")) -> None:
    """A column for each feature, only here; everywhere else features are one array."""
    features.select(*metadata, *(F.col("features")[i].alias(n) for i, n in enumerate(names))).write.csv(path, header=True, mode="overwrite")


def write_json(row: DataFrame, path: str) -> None:
    """One row of results as indented JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row.first().asDict(recursive=True), f, indent=2, default=str)


def with_ordinal(df: DataFrame, *order: str) -> DataFrame:
    """seq_idx within each genus, for tables that have no order of their own.

    Only keys are sorted, by ranges: a range's ordinals go on from the counts of those before it, so no task has a whole
    genus, and rows get their ordinals by a join. Rows of equal keys are numbered in no particular order.
    """
    keys = ["genus", *order]
    ranged = stored(df.groupBy(*keys).agg(F.count("*").alias("__n")).repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ordinals")
    so_far = lambda n, w: F.sum(n).over(w) - F.col(n)
    sums = ranged.groupBy(F.col("__range").alias("__r"), F.col("genus").alias("__g")).agg(F.sum("__n").alias("__sum")).withColumn("__before", so_far("__sum", Window.partitionBy("__g").orderBy("__r")))  # few rows
    at = ranged.join(F.broadcast(sums), (F.col("__range") == F.col("__r")) & F.col("genus").eqNullSafe(F.col("__g")))
    at = at.withColumn("__at", F.col("__before") + so_far("__n", Window.partitionBy("__range", "genus").orderBy(*order)))
    at = at.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(keys)), "__at")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"__{i}"))
    out = df.join(at, on)
    if not ranged.filter("__n > 1").isEmpty():
        out = out.withColumn("__at", F.col("__at") + F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)
    return out.select(*df.columns, F.col("__at").cast("long").alias("seq_idx"))
