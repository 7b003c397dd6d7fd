"""Cleaning: label and quality filters with accounting, exact and containment dedup, chimera plug-in, summary."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Cleaning
from ..functions import sequences
from . import chimera
from .containment import contained

COUNTERS = {
    "dropped_ambiguous_label": "ambiguous_label",
    "dropped_length_out_of_range": "length_out_of_range",
    "dropped_too_many_ambiguous_bases": "too_many_ambiguous_bases",
    "dropped_empty_sequence": "empty_sequence",
}


def with_reason(records: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:  # noqa: B008
    """drop_reason of each record: its label counts before its sequence; ``pass`` if there is none."""
    sequence = F.translate("sequence", "Tt", "Uu") if c.normalize_t else F.col("sequence")
    ambiguous = sequences.is_ambiguous_label(F.col("header"), c.terms, c.word_boundary)
    return records.withColumn("sequence", sequence).withColumn("drop_reason", F.when(ambiguous, "ambiguous_label").otherwise(sequences.quality_reason(F.col("sequence"), c.min_len, c.max_len, c.max_n_frac)))


def _scope(records: DataFrame) -> list[str]:
    """Records are cleaned file by file where they say which file they are from, else genus by genus; ordinals are unique in it."""
    return ["genus", "file"] if "file" in records.columns else ["genus"]


def exact_dedup(records: DataFrame, strand: str = "forward") -> DataFrame:
    """The first record of each genus (and file) and upper-case sequence; strand ``both`` takes reverse complements as equal.

    A grouped minimum of the ordinal, not a window: copies are combined before the shuffle.
    """
    return records.join(_first(records, strand), [*_scope(records), "seq_idx"], "left_semi")


def _first(records: DataFrame, strand: str) -> DataFrame:
    key = F.upper("sequence")
    if strand == "both":
        key = F.least(key, sequences.reverse_complement(key))
    scope = _scope(records)
    return records.groupBy(*scope, _letters(key)).agg(F.min("seq_idx").alias("seq_idx")).select(*scope, "seq_idx")


def _letters(key: Column) -> Column:
    """Stands for a sequence where equal ones are looked for, so that sequences aren't shuffled: SHA-256."""
    return F.unhex(F.sha2(key, 256)).alias("__k")


def nested(records: DataFrame, strand: str = "both") -> DataFrame:
    """(genus, file if there is one, seq_idx) of sequences that a longer one of their genus, or an equally long earlier one, contains."""
    return contained(records, _scope(records), strand=strand)


def drop_nested(records: DataFrame, strand: str = "both") -> DataFrame:
    return records.join(nested(records, strand).hint("merge"), [*_scope(records), "seq_idx"], "left_anti")


def without_tool(records: DataFrame) -> tuple[DataFrame, str]:
    """The default chimera step: passes everything on and says so."""
    return records, "skipped"


def without_chimeras(skew: float = chimera.SKEW, least: int = chimera.LEAST) -> ChimeraFilter:
    """The step that takes away what chimera.find names; a sequence's abundance is the sum of its copies' sizes."""

    def remove(records: DataFrame) -> tuple[DataFrame, str]:
        scope = _scope(records)
        return records.join(chimera.find(records, scope, skew, least).hint("merge"), [*scope, "seq_idx"], "left_anti"), "ran"  # by files' size it would be sent to the tasks

    return remove


def vsearch(records: DataFrame) -> tuple[DataFrame, str]:
    """De-novo chimera removal by the ``vsearch`` program, where executors have it; a genus (and file) is one run of it."""
    if shutil.which("vsearch") is None:
        return without_tool(records)

    def run(p):
        with tempfile.TemporaryDirectory() as d:
            with open(f"{d}/in.fa", "w") as f:
                f.writelines(f">{i};size={n}\n{s}\n" for i, n, s in zip(p["seq_idx"], p["size"], p["sequence"], strict=True))
            subprocess.run(["vsearch", "--uchime_denovo", f"{d}/in.fa", "--nonchimeras", f"{d}/out.fa"], check=True, capture_output=True)
            with open(f"{d}/out.fa") as f:
                stay = {int(x[1:].split(";")[0]) for x in f if x.startswith(">")}
        return p[p["seq_idx"].isin(stay)]

    return records.groupBy(*_scope(records)).applyInPandas(run, records.schema), "ran"


def with_size(staged: DataFrame, stage: str = "nonnested") -> DataFrame:
    """The records of a stage with size, the sum of their header's sizes and those of their dropped copies."""
    scope, key = _scope(staged), F.upper("sequence")
    copies = staged.filter(F.col("drop_reason").isin("pass", "duplicate", "nested")).groupBy(*scope, _letters(key)).agg(F.sum(chimera.abundance(F.col("header"))).alias("size"))
    stay = in_stage(staged, stage)
    return stay.withColumn("__k", _letters(key)).join(copies, [*scope, "__k"]).select(*stay.columns, "size")


ChimeraFilter = Callable[[DataFrame], tuple[DataFrame, str]]


def chimera_filter(c: Cleaning) -> ChimeraFilter:
    """The step that the parameters name."""
    if c.chimeras not in ("skip", "denovo", "vsearch"):
        raise ValueError(f"no chimera step {c.chimeras!r}")
    return {"skip": without_tool, "vsearch": vsearch}.get(c.chimeras) or without_chimeras(c.skew, c.least_segment)


#: What a record of stages() may have come to, and the stages that it is still in then.
STAGES = ("label_quality", "dedup", "nonnested")


def stages(records: DataFrame, c: Cleaning = Cleaning()) -> DataFrame:  # noqa: B008
    """All records with drop_reason: why one goes, ``duplicate`` and ``nested`` included, or ``pass``; in one plan."""
    judged = with_reason(records, c)
    keys = [*_scope(records), "seq_idx"]
    passed = judged.filter("drop_reason = 'pass'")
    first = _first(passed, c.dedup)
    # copies may stay among what contains: they are in their first copy, and a duplicate whatever else; forward containment isn't the same of a reverse complement
    inside = nested(passed.join(first, keys, "left_semi") if (c.dedup, c.strand) == ("both", "forward") else passed, c.strand)
    on = judged.join(first.withColumn("__first", F.lit(True)), keys, "left").join(inside.withColumn("__nested", F.lit(True)).hint("merge"), keys, "left")
    reason = F.when(F.col("drop_reason") != "pass", F.col("drop_reason")).when(F.col("__first").isNull(), "duplicate").when(F.col("__nested"), "nested").otherwise("pass")
    return on.select(*records.columns, reason.alias("drop_reason"))


def in_stage(staged: DataFrame, stage: str) -> DataFrame:
    """The records that are still there after a stage, one of STAGES."""
    left = {"label_quality": ("pass", "duplicate", "nested"), "dedup": ("pass", "nested"), "nonnested": ("pass",)}[stage]
    return staged.filter(F.col("drop_reason").isin(*left)).drop("drop_reason")


def clean(records: DataFrame, c: Cleaning = Cleaning(), chimeras: ChimeraFilter | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The records that stay, and per genus (and file) how many each step took; genera that lose all are listed too."""
    return summarized(stages(records, c), chimeras or chimera_filter(c))


def summarized(staged: DataFrame, chimeras: ChimeraFilter = without_tool) -> tuple[DataFrame, DataFrame]:
    """The same of records that have been through stages()."""
    scope = _scope(staged)
    stay, status = chimeras(in_stage(staged, "nonnested") if chimeras is without_tool else with_size(staged))
    stay = stay.drop("size")
    is_ = lambda *reasons: F.count_if(F.col("drop_reason").isin(*reasons))
    counts = staged.groupBy(*scope).agg(F.count("*").alias("input"), *(is_(reason).alias(name) for name, reason in COUNTERS.items()), is_("pass", "duplicate", "nested").alias("passed_quality"), is_("duplicate").alias("dropped_duplicates"), is_("nested").alias("dropped_nested"), is_("pass").alias("after_nested"))
    if chimeras is without_tool:
        counts = counts.withColumn("final", F.col("after_nested"))
    else:
        counts = counts.join(stay.groupBy(*scope).agg(F.count("*").alias("final")), scope, "left").fillna(0, ["final"])
    return stay, counts.select(*scope, "input", *(n for n in COUNTERS if n != "dropped_empty_sequence"), "passed_quality", "dropped_duplicates", "dropped_nested", (F.col("after_nested") - F.col("final")).alias("dropped_chimeras"), "final", F.lit(status).alias("chimera_status"), "dropped_empty_sequence")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows but the first of each key, nulls being a key like any other; order has to tell a key's rows apart.

    A grouped minimum and a join on the keys' hash: a key with very many rows is combined before the shuffle,
    and the join's side with all rows can be split.
    """
    first = df.groupBy(F.xxhash64(*keys).alias("__h"), *(F.col(k).alias(f"__{i}") for i, k in enumerate(keys))).agg(F.min(F.struct(*order)).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    on = F.xxhash64(*keys) == F.col("__h")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__{i}"))
    return df.join(first, on).filter(F.struct(*order) > F.col("__first")).select(*df.columns)
