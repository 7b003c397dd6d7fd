"""What the operators share: scratch tables, files for all workers, Arrow batches and byte-level text rules."""

from __future__ import annotations

import gc
import mmap
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes of strings that an operator gets at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: White space of the text contracts.
SPACE = " \t\n\x0b\x0c\r"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables in the folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``; only where that is unset and the master is this machine
    (tests) a temporary folder is set as the checkpoint directory and used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="kmerloom-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/kmerloom/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, lost executors don't matter.

    Shuffle files behind the table are of no more use; a collection of garbage lets Spark remove them.
    """
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession, name)
    df.write.parquet(path)
    del df
    release(spark)
    out = spark.read.schema(schema).parquet(path)
    out.__dict__["kept_in"] = path
    return out


def release(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Deletes tables of keep() that nothing reads any more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.__dict__["kept_in"])
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(column: pa.Array) -> np.ndarray | int:
    """Bytes of each row's string, or of any row where rows don't differ by much."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return 8


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes of strings, whatever Spark sends."""
    for b in batches:
        if b.num_rows <= BATCH_ROWS and b.nbytes <= BATCH_BYTES:
            yield b
            continue
        ends = np.cumsum(np.broadcast_to(sum(map(_bytes, b.columns)), b.num_rows))
        at = 0
        while at < b.num_rows:
            before = ends[at - 1] if at else 0
            to = min(max(int(np.searchsorted(ends, before + BATCH_BYTES, "right")), at + 1), at + BATCH_ROWS, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches small enough for long texts; Spark's own bound on a batch's bytes holds before that."""
    return df.mapInArrow(lambda batches: fn(sliced(batches)), schema)


def ship(spark: SparkSession, data: bytes, name: str) -> str:
    """Stores bytes in the shared folder and has Spark give each executor one copy as a file; returns the file's name.

    Executors that come later fetch it too.
    """
    path = scratch(spark, name)
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(to, True)
    try:
        for i in range(0, len(data), 1 << 22):
            out.write(bytearray(data[i : i + (1 << 22)]))
    finally:
        out.close()
    spark.sparkContext.addFile(to.toString())
    return path.rpartition("/")[2]


def mapped(name: str) -> mmap.mmap:
    """A shipped file, memory-mapped: the workers of an executor share its pages."""
    from pyspark import SparkFiles

    with open(SparkFiles.get(name), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def texts(column: pa.Array) -> list[str]:
    """Null texts are empty."""
    return [x or "" for x in column.to_pylist()]


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def documents(df: DataFrame, *columns: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns an operator needs, so that extra columns can't clash with its own."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *columns)


def most_frequent(counts: DataFrame, words: int) -> list[tuple[str, int]]:
    """About the ``words`` most frequent rows of (word, n), never more: whole steps of frequency, so no tie is cut.

    Frequencies are tallied in steps of a sixteenth of a power of two first; only words above the step at
    which the list would grow too long come to the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int").alias("step")
    tally = sorted(counts.select(step).groupBy("step").count().collect(), reverse=True)
    total, least = 0, None
    for s, n in tally:
        total += n
        if total > words:
            break
        least = s
    if least is None:
        return []
    return sorted(((r["word"], r["n"]) for r in counts.filter(F.floor(F.log2("n") * 16) >= least).select("word", "n").collect()), key=lambda r: (-r[1], r[0]))
