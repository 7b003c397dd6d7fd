"""What the jobs share: their config files, the records of a table, and logging."""

from __future__ import annotations

import logging
import sys
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.config import Cleaning, Kmers, Splitting

log = logging.getLogger("jobs")


@dataclass(frozen=True)
class Columns:
    """SQL expressions over the input table; the id is a whole number, unique in the table."""

    id: str = "doc_id"
    genus: str = "lang"
    accession: str = "source"
    header: str = "source"
    # letters of the text stand in for bases
    sequence: str = "translate(upper(regexp_replace(text, '[^A-Za-z]', '')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGUACGUACGUACGUACGUACGUAC')"


@dataclass(frozen=True)
class Settings:
    format: str = "parquet"  # or orc, json, csv: what Spark reads
    schema: str = ""  # of the input; where it is empty Spark finds it out, which needs a file to be there
    options: dict = field(default_factory=dict)  # of Spark's reader
    files_at_once: int = 0  # of a stream; 0: all that are there make one batch
    columns: Columns = Columns()
    cleaning: Cleaning = field(default_factory=lambda: Cleaning(min_len=200, max_len=20_000, terms=("7",)))
    kmers: Kmers = Kmers(k=3)
    splitting: Splitting = Splitting()


def settings(path: str | None) -> Settings:
    """Settings from a TOML file; what it doesn't name keeps its default, an unknown name is an error."""
    if path is None:
        return Settings()
    with open(path, "rb") as f:
        given = tomllib.load(f)
    base = Settings()
    for name, value in given.items():
        known = {f.name for f in fields(Settings)}
        if name not in known:
            raise ValueError(f"{path}: unknown setting {name}")
        if isinstance(value, dict) and name != "options":
            part = getattr(base, name)
            if unknown := set(value) - {f.name for f in fields(part)}:
                raise ValueError(f"{path}: unknown settings {sorted(unknown)} in {name}")
            given[name] = type(part)(**{f.name: getattr(part, f.name) for f in fields(part)} | {k: tuple(v) if isinstance(v, list) else v for k, v in value.items()})
    return Settings(**{f.name: given.get(f.name, getattr(base, f.name)) for f in fields(Settings)})


def reader(spark: SparkSession, s: Settings):
    """Spark's reader with the settings' format, options and schema."""
    r = spark.read.format(s.format).options(**s.options)
    return r.schema(s.schema) if s.schema else r


def records(table: DataFrame, c: Columns) -> DataFrame:
    """seq_idx (the id), genus, accession, header, sequence; null sequences are empty. Only these columns are read."""
    return table.select(F.expr(c.id).cast("long").alias("seq_idx"), F.expr(c.genus).cast("string").alias("genus"), F.expr(c.accession).cast("string").alias("accession"), F.coalesce(F.expr(c.header).cast("string"), F.lit("")).alias("header"), F.coalesce(F.expr(c.sequence), F.lit("")).alias("sequence"))


def main(run: Callable[[SparkSession, str, str, Settings], object], what: str) -> None:
    """Command line of a job: the only place where a session is made and stopped."""
    import argparse

    p = argparse.ArgumentParser(description=what)
    p.add_argument("source", help="folder or file that Spark reads")
    p.add_argument("target", help="folder for what the job writes, its checkpoint included")
    p.add_argument("--config", help="TOML file")
    a = p.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(what).getOrCreate()
    try:
        run(spark, a.source, a.target, settings(a.config))
    finally:
        spark.stop()
