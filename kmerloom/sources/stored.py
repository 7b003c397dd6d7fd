"""Tables that are written to the folder which driver and executors share, and read back: plans end there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in ``spark.checkpoint.dir``, or in a temporary folder on one machine only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="kmerloom-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Shuffled bytes that Spark aims at for a task: rows of digests and shared places take some forty times that in memory.
ADVISED = "8m"


@contextmanager
def small_tasks(spark: SparkSession):
    """Adaptive execution joins small partitions up to ADVISED only; the session's setting comes back."""
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ADVISED)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


@contextmanager
def measured_joins(spark: SparkSession):
    """Joins send a side to all tasks only where adaptive execution has measured it; the session's settings come back.

    Before that Spark goes by the size of files, and what is made from stored ones may be a hundred times as large: the
    driver would hold it whole.
    """
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(planned), spark.conf.get(measured, None)
    spark.conf.set(measured, before[1] or before[0])
    spark.conf.set(planned, "-1")
    try:
        yield
    finally:
        spark.conf.set(planned, before[0])
        if before[1] is None:
            spark.conf.unset(measured)
        else:
            spark.conf.set(measured, before[1])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written and read back: a lost executor costs a scan, not what came before."""
    path = shared_folder(df.sparkSession, name)
    with small_tasks(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["stored_in"] = path
    return out


def dealt(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like stored(), in buckets of a key: a join by it shuffles the other side only, however often. A table of the session by a name of its own, which discard() drops."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    table, n = f"{name}_{uuid.uuid4().hex}".replace("-", "_"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).format("parquet").bucketBy(n, key).saveAsTable(table)
    out = spark.table(table)
    out.__dict__.update(stored_in=path, table=table)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() and dealt() that nothing reads any more."""
    for t in tables:
        if table := t.__dict__.get("table"):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.__dict__["stored_in"])
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
