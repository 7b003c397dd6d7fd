"""Stages of a run: tables in a shared folder, each under a fingerprint of what it was made from.

A stage is written once and read back, so no plan holds more than one stage's work. Its folder's name ends in a digest of
the stage's name, its parameters and its inputs' fingerprints; a later run with the same ones finds it whole (Spark's
``_SUCCESS`` mark) and skips it. A stage that was broken off has no mark and is written anew.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import shared_folder

#: Part of every fingerprint; to be raised when a stage's result changes with the code.
VERSION = 1


class Stages:
    """folder: where stages are kept and looked for; without one a new folder, so that nothing is skipped but plans end all the same."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.done = spark, (folder or shared_folder(spark, "stages")).rstrip("/"), []

    def table(self, name: str, make: Callable[[], DataFrame], *of: Any) -> DataFrame:
        """The stage's table. of: what it is made from, tables of stages, other tables and parameters."""
        mark = self._mark(name, of)
        path, began = f"{self.folder}/{name}-{mark}", time.time()
        found = self._whole(path)
        if not found:
            make().write.mode("overwrite").parquet(path)
        out = self.spark.read.parquet(path)
        out.__dict__["stage"] = mark
        self._note(name, mark, out.count(), began, found)
        return out

    def model(self, name: str, make: Callable[[], Any], save: Callable[[Any, str], None], restore: Callable[[str], Any], *of: Any) -> Any:
        """The same for what isn't a table; save has to write ``about`` last."""
        mark = self._mark(name, of)
        path, began = f"{self.folder}/{name}-{mark}", time.time()
        if found := self._whole(f"{path}/about"):
            out = restore(path)
        else:
            save(out := make(), path)
        self._note(name, mark, None, began, found)
        return out

    def note(self, name: str, values: dict) -> None:
        """Stores one row of results as JSON, always anew."""
        self.spark.createDataFrame([(json.dumps(values, default=str, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{name}.json")

    def read_note(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}.json").first()[0])

    def finish(self, **more: Any) -> None:
        """Stores the run's stages (name, fingerprint, rows, seconds, whether it was found) and more as ``run_metadata.json``."""
        self.note("run_metadata", {"version": VERSION, "stages": self.done, **more})

    def files(self, folder: str, pattern: str) -> str:
        """A fingerprint of files by name, length and time of change; their content isn't read."""
        one = self.spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", "modificationTime")
        return self._sum(one)

    def _sum(self, df: DataFrame) -> str:
        n, total = df.select(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
        return f"{n}:{total}"

    def _mark(self, name: str, of: tuple) -> str:
        """Tables that no stage has made are read once for a digest of their rows, in whatever order."""
        parts = [str(VERSION), name]
        for x in of:
            parts.append((x.__dict__.get("stage") or self._sum(x)) if isinstance(x, DataFrame) else repr(x))
        return hashlib.sha256("\0".join(parts).encode()).hexdigest()[:24]

    def _whole(self, path: str) -> bool:
        mark = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)

    def _note(self, name: str, mark: str, rows: int | None, began: float, found: bool) -> None:
        self.done.append({"stage": name, "fingerprint": mark, "rows": rows, "seconds": round(time.time() - began, 3), "found": found})
