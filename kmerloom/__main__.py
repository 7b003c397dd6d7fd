"""Command line of the entry points.

    python -m kmerloom STEP FOLDER OUT [--config FILE] [--model NAME]

STEP is clean, features, train, diagnose or all. FOLDER holds FASTA files. A step takes what earlier ones have left in
``OUT/stages`` and makes what isn't there yet. FILE is TOML, with a section for each group of parameters of
``kmerloom/config.py`` (``[cleaning]``, ``[kmers]``, ``[forest]`` ...).
"""

from __future__ import annotations

import argparse
import tomllib
from dataclasses import fields

from pyspark.sql import SparkSession

from . import config
from .operators import models
from .plans import pipeline
from .plans.stages import Stages
from .sources import fasta

STEPS = ("clean", "features", "train", "diagnose", "all")
GROUPS = {"cleaning": config.Cleaning, "kmers": config.Kmers, "splitting": config.Splitting, "reducing": config.Reducing, "forest": config.Forest, "boosting": config.Boosting, "profiling": config.Profiling}


def parameters(path: str | None) -> dict:
    """Each group's parameters, with defaults for what the file doesn't name; an unknown name is an error."""
    given = {}
    if path:
        with open(path, "rb") as f:
            given = tomllib.load(f)
    if unknown := set(given) - set(GROUPS):
        raise ValueError(f"{path}: unknown sections {sorted(unknown)}")
    for name, values in given.items():
        if unknown := set(values) - {f.name for f in fields(GROUPS[name])}:
            raise ValueError(f"{path}: unknown parameters {sorted(unknown)} of {name}")
    return {name: kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.get(name, {}).items()}) for name, kind in GROUPS.items()}


def run(spark: SparkSession, step: str, folder: str, out: str, p: dict, which: tuple[str, ...] = models.MODELS) -> None:
    """What a step writes below out: cleaned FASTA, feature tables, metrics as JSON, quality tables."""
    out = out.rstrip("/")
    if step == "all":
        pipeline.from_folder(spark, folder, out, p["cleaning"], p["kmers"], p["splitting"], p["reducing"], p["forest"], p["boosting"], p["profiling"], which)
    st = Stages(spark, f"{out}/stages")
    records, summary = pipeline.clean_folder(spark, folder, f"{out}/clean" if step in ("clean", "all") else None, p["cleaning"], stages=st)
    if step == "clean":
        return
    f = pipeline.build_features(records, p["kmers"], p["splitting"], p["reducing"], st)
    if step in ("features", "all"):
        f.taxonomy.write.csv(f"{out}/taxonomy", header=True, mode="overwrite")
        f.manifest.write.csv(f"{out}/manifest", header=True, mode="overwrite")
        f.dropped.coalesce(1).write.csv(f"{out}/dropped_features", header=True, mode="overwrite")
        fasta.write_wide_csv(f.reduced, f.kept, f"{out}/reduced", ("sequence_id", "genus", "split"))
    if step in ("train", "all"):
        for m in which:
            t = pipeline.train_and_evaluate(f.reduced, f.taxonomy, f.kept, m, forest=p["forest"], boosting=p["boosting"], s=p["splitting"], stages=st)
            t.test.coalesce(1).write.csv(f"{out}/{m}/test_report", header=True, mode="overwrite")
            t.roc.write.csv(f"{out}/{m}/roc", header=True, mode="overwrite")
            spark.createDataFrame(t.importance, "kmer string, importance double").coalesce(1).write.csv(f"{out}/{m}/importance", header=True, mode="overwrite")
    if step in ("diagnose", "all"):
        for name, table in pipeline.diagnose(f.reduced.drop("split"), f.taxonomy, len(f.kept), p["profiling"], st).items():
            if name == "summary_text":
                table.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(f"{out}/diagnosis/{name}")
            elif not any(t.startswith("array") for _, t in table.dtypes):
                table.write.csv(f"{out}/diagnosis/{name}", header=True, mode="overwrite")
            else:
                table.write.mode("overwrite").parquet(f"{out}/diagnosis/{name}")


def main() -> None:
    a = argparse.ArgumentParser(prog="kmerloom")
    a.add_argument("step", choices=STEPS)
    a.add_argument("folder")
    a.add_argument("out")
    a.add_argument("--config")
    a.add_argument("--model", choices=models.MODELS)
    given = a.parse_args()
    spark = SparkSession.builder.appName(f"kmerloom {given.step}").getOrCreate()
    try:
        run(spark, given.step, given.folder, given.out, parameters(given.config), (given.model,) if given.model else models.MODELS)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
