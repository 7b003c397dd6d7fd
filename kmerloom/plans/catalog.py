"""Queries over the driver's tables and the SQL that checks them.

Roles: ``documents`` are sequences (genus is the language, accession the source, the sequence 128 bases of
surrogate RNA made from hashes of the text), ``embeddings`` a feature table (genus is the label, accession
vec_id modulo 50), ``labels`` a taxonomy with gaps and predictions, ``customer`` scores of classes,
``part`` headers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cleaning, Kmers, Profiling
from ..functions import sequences
from ..operators import blocks, chimera, clean, correlation, embed, evaluate, explain, kmers, layout, models, split, stats, taxonomy
from ..sources import fasta
from ..sources.stored import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TERMS = ("worthless", "released under", "the and", "idiot", "sp.")
CORRELATED, DEGREE = 0.10, 0.12
N_FEATURES = 64


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def surrogate(text, parts: int = 4):
    """RNA made from hashes of a text: 32 bases for each part."""
    return F.concat(*(F.translate(F.md5(F.concat(text, F.lit(f":{i}"))), "0123456789abcdef", "ACGUACGUACGUACGU") for i in range(parts)))


def rna(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("lang").alias("genus"), F.col("source").alias("accession"), F.col("doc_id").alias("seq_idx"), F.col("source").alias("header"), surrogate(F.col("text")).alias("sequence"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("genus"), (F.col("vec_id") % 50).alias("accession"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def r6(c: str):
    return F.round(c, 6).alias(c)


_RNA = "translate(md5(text || ':{}'), '0123456789abcdef', 'ACGUACGUACGUACGU')"
_SEQ = f"SELECT doc_id, lang AS genus, source AS accession, {' || '.join(_RNA.format(i) for i in range(4))} AS sequence FROM documents"


def _windows(k: int) -> str:
    """doc_id, genus, kmer: letters in order, each with those after it."""
    after = " || ".join(["c", *(f"lead(c, {i}) OVER w" for i in range(1, k))])
    return f"""
seq AS ({_SEQ}),
letters AS (SELECT doc_id, genus, unnest(string_split(sequence, '')) AS c, unnest(range(length(sequence))) AS i FROM seq),
win AS (SELECT doc_id, genus, kmer FROM (SELECT doc_id, genus, {after} AS kmer FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE kmer IS NOT NULL)"""


_LONG = "long AS (SELECT vec_id, label, unnest(range(len(embedding))) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_STATS = "st AS (SELECT idx, count(*) AS rows, avg(x) AS mean, stddev_samp(x) AS std, var_samp(x) AS variance, min(x) AS minimum, max(x) AS maximum, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS fraction_zero FROM long GROUP BY idx)"
_PAIRS = "prs AS (SELECT a.idx AS f1, b.idx AS f2, corr(a.x, b.x) AS r FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.idx < b.idx GROUP BY a.idx, b.idx)"


# --- labels, quality, accounting -------------------------------------------------------------------------


@query(f"SELECT doc_id, {' OR '.join(f"contains(lower(text), '{t}')" for t in TERMS)} AS ambiguous FROM documents")
def label_filter(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", sequences.is_ambiguous_label(F.col("text"), TERMS).alias("ambiguous"))


_REASON = "CASE WHEN contains(lower(source), '1') THEN 'ambiguous_label' WHEN length(text) < 500 OR length(text) > 5000 THEN 'length_out_of_range' WHEN length(text) = 0 THEN 'empty_sequence' WHEN length(translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ', '')) > CAST(0.05 AS DOUBLE) * length(text) THEN 'too_many_ambiguous_bases' ELSE 'pass' END"


@query(f"SELECT lang AS genus, drop_reason, count(*) AS n FROM (SELECT lang, {_REASON} AS drop_reason FROM documents) GROUP BY ALL")
def quality_reason_counts(spark, sf_dir):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ "
    n = F.length("text")
    ambiguous = F.length(F.translate("text", letters, ""))
    reason = F.when(sequences.is_ambiguous_label(F.col("source"), ["1"]), "ambiguous_label").when((n < 500) | (n > 5000), "length_out_of_range").when(n == 0, "empty_sequence").when(ambiguous > 0.05 * n, "too_many_ambiguous_bases").otherwise("pass")
    return load(spark, sf_dir, "documents").select(F.col("lang").alias("genus"), reason.alias("drop_reason")).groupBy("genus", "drop_reason").agg(F.count("*").alias("n"))


_CLEAN_REASON = "CASE WHEN contains(lower(source), '7') THEN 'ambiguous_label' WHEN length(sequence) < 40 OR length(sequence) > 110 THEN 'length_out_of_range' ELSE 'pass' END"
_FRAGMENTS = f"frag AS (SELECT doc_id, genus, accession AS source, CASE WHEN doc_id % 3 = 0 THEN substr(sequence, 1, 120) WHEN doc_id % 3 = 1 THEN substr(sequence, 11, 90) ELSE reverse(translate(substr(sequence, 21, 60), 'ACGU', 'UGCA')) END AS sequence FROM (SELECT d.doc_id, d.genus, d.accession, b.sequence FROM seq d JOIN seq b ON b.doc_id = d.doc_id - d.doc_id % 3))"


def fragments(spark, sf_dir) -> DataFrame:
    """Of every three documents one has a sequence and the others a part of it, one of them on the other strand."""
    s = rna(spark, sf_dir)
    base = s.select(F.col("doc_id").alias("b"), F.col("sequence").alias("whole"))
    of = s.drop("sequence").join(base, F.col("b") == F.col("doc_id") - F.col("doc_id") % 3)
    part = F.when(F.col("doc_id") % 3 == 0, F.substring("whole", 1, 120)).when(F.col("doc_id") % 3 == 1, F.substring("whole", 11, 90)).otherwise(sequences.reverse_complement(F.substring("whole", 21, 60)))
    return of.select("doc_id", "genus", "accession", "seq_idx", "header", part.alias("sequence"))


@query(f"""
WITH seq AS ({_SEQ}), {_FRAGMENTS},
j AS (SELECT *, {_CLEAN_REASON} AS reason FROM frag),
p AS (SELECT * FROM j WHERE reason = 'pass'),
u AS (SELECT genus, min(doc_id) AS doc_id, sequence FROM p GROUP BY genus, sequence),
k AS (SELECT * FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.genus = a.genus AND (length(b.sequence) > length(a.sequence) OR (length(b.sequence) = length(a.sequence) AND b.doc_id < a.doc_id)) AND (contains(b.sequence, a.sequence) OR contains(b.sequence, reverse(translate(a.sequence, 'ACGU', 'UGCA'))))))
SELECT genus, count(*) AS input, count(*) FILTER (reason = 'ambiguous_label') AS dropped_ambiguous_label, count(*) FILTER (reason = 'length_out_of_range') AS dropped_length_out_of_range,
       (SELECT count(*) FROM p WHERE p.genus = j.genus) AS passed_quality,
       (SELECT count(*) FROM p WHERE p.genus = j.genus) - (SELECT count(*) FROM u WHERE u.genus = j.genus) AS dropped_duplicates,
       (SELECT count(*) FROM u WHERE u.genus = j.genus) - (SELECT count(*) FROM k WHERE k.genus = j.genus) AS dropped_nested,
       (SELECT count(*) FROM k WHERE k.genus = j.genus) AS final
FROM j GROUP BY genus""")
def cleaning_summary(spark, sf_dir):
    _, summary = clean.clean(fragments(spark, sf_dir), Cleaning(min_len=40, max_len=110, terms=("7",)))
    return summary.select("genus", "input", "dropped_ambiguous_label", "dropped_length_out_of_range", "passed_quality", "dropped_duplicates", "dropped_nested", "final")


@query(f"""
WITH seq AS ({_SEQ}), {_FRAGMENTS}, j AS (SELECT *, {_CLEAN_REASON} AS reason FROM frag),
u AS (SELECT *, row_number() OVER (PARTITION BY genus, sequence ORDER BY doc_id) AS rn FROM j WHERE reason = 'pass')
SELECT j.doc_id, CASE WHEN j.reason <> 'pass' THEN j.reason WHEN u.rn > 1 THEN 'duplicate'
  WHEN EXISTS (SELECT 1 FROM u b WHERE b.rn = 1 AND b.genus = j.genus AND (length(b.sequence) > length(j.sequence) OR (length(b.sequence) = length(j.sequence) AND b.doc_id < j.doc_id)) AND (contains(b.sequence, j.sequence) OR contains(b.sequence, reverse(translate(j.sequence, 'ACGU', 'UGCA'))))) THEN 'nested' ELSE 'pass' END AS drop_reason
FROM j LEFT JOIN u USING (doc_id)""")
def cleaning_stages(spark, sf_dir):
    """What became of each record."""
    staged = clean.stages(fragments(spark, sf_dir), Cleaning(min_len=40, max_len=110, terms=("7",)))
    return staged.select("doc_id", "drop_reason")


@query("SELECT lang AS genus, 'skipped' AS chimera_status, CAST(0 AS BIGINT) AS dropped_chimeras FROM documents GROUP BY lang")
def chimera_step(spark, sf_dir):
    """Without the program, records pass and the summary says so."""
    _, summary = clean.clean(rna(spark, sf_dir), Cleaning(min_len=1, max_len=1000, terms=()))
    return summary.select("genus", "chimera_status", "dropped_chimeras")


_CONSERVED = "GGAUUAGAUACCCUGGUAGUCCACGCCGUAAACGAUGAGU"
_MOSAIC = f"""mosaic AS (SELECT a.doc_id, a.genus, CASE WHEN a.doc_id % 4 < 2 THEN 2 + a.doc_id % 3 ELSE 1 + a.doc_id // 4 % 2 END AS size,
  '{_CONSERVED}' || CASE WHEN a.doc_id % 4 = 2 THEN substr(b.sequence, 1, 20 + a.doc_id % 80) || substr(c.sequence, 21 + a.doc_id % 80) WHEN a.doc_id % 4 = 3 THEN substr(b.sequence, 1, 64) || substr(a.sequence, 65) ELSE a.sequence END AS sequence
  FROM (SELECT s.doc_id, g.genus, s.sequence FROM seq s JOIN seq g ON g.doc_id = s.doc_id - s.doc_id % 4) a JOIN seq b ON b.doc_id = a.doc_id - a.doc_id % 4 JOIN seq c ON c.doc_id = b.doc_id + 1)"""


def _chimeric(rec: str) -> str:
    """SQL of the chimeras of a table (doc_id, genus, size, sequence): every pair of sequences, letter by letter."""
    shared = lambda q, b: f"coalesce(list_position(list_transform(range(1, least(length({q}), length({b})) + 1), lambda i: substr({q}, i, 1) <> substr({b}, i, 1)), true) - 1, least(length({q}), length({b})))"
    return f"""ends AS (SELECT q.doc_id, b.doc_id AS parent, length(q.sequence) AS n, least({shared("q.sequence", "b.sequence")}, length(q.sequence) - 32) AS l, least({shared("reverse(q.sequence)", "reverse(b.sequence)")}, length(q.sequence) - 32) AS r
  FROM {rec} q JOIN {rec} b ON b.genus = q.genus AND b.size >= 2 * q.size),
chimeric AS (SELECT DISTINCT x.doc_id FROM (SELECT * FROM ends WHERE l >= 32) x JOIN (SELECT * FROM ends WHERE r >= 32) y ON y.doc_id = x.doc_id AND y.parent <> x.parent WHERE x.l + y.r >= x.n)"""


def mosaics(spark, sf_dir) -> DataFrame:
    """Of every four documents two have a sequence of their own, one the start of the first and the end of the second, one shares a start only; all begin with one conserved region."""
    s = rna(spark, sf_dir)
    first = F.col("doc_id") - F.col("doc_id") % 4
    one = s.select(F.col("doc_id").alias("b"), F.col("genus").alias("g"), F.col("sequence").alias("first_part"))
    two = s.select((F.col("doc_id") - 1).alias("b"), F.col("sequence").alias("second_part"))
    of = s.withColumn("b", first).join(one, "b").join(two, "b")
    at = F.lit(20) + F.col("doc_id") % 80
    mixed = F.concat(F.substring("first_part", F.lit(1), at), F.substring("second_part", at + 1, F.length("second_part")))
    text = F.when(F.col("doc_id") % 4 == 2, mixed).when(F.col("doc_id") % 4 == 3, F.concat(F.substring("first_part", 1, 64), F.substring(F.col("sequence"), F.lit(65), F.length("sequence")))).otherwise(F.col("sequence"))
    size = F.when(F.col("doc_id") % 4 < 2, 2 + F.col("doc_id") % 3).otherwise(1 + F.floor(F.col("doc_id") / 4) % 2)
    return of.select("doc_id", F.col("g").alias("genus"), "accession", "seq_idx", F.concat(F.col("header"), F.lit(";size="), size.cast("string")).alias("header"), F.concat(F.lit(_CONSERVED), text).alias("sequence"))


@query(f"WITH seq AS ({_SEQ}), {_MOSAIC}, {_chimeric('mosaic')} SELECT doc_id, genus FROM mosaic WHERE doc_id IN (SELECT doc_id FROM chimeric)")
def chimeras_found(spark, sf_dir):
    """Sequences that the start of one at least twice as abundant and the end of another make up."""
    m = mosaics(spark, sf_dir)
    found = chimera.find(m.withColumn("size", chimera.abundance(F.col("header"))), ["genus"])
    return found.select(F.col("seq_idx").alias("doc_id"), "genus")


@query(f"""
WITH seq AS ({_SEQ}), {_MOSAIC}, one AS (SELECT genus, min(doc_id) AS doc_id, CAST(sum(size) AS BIGINT) AS size, sequence FROM mosaic GROUP BY genus, sequence), {_chimeric('one')}
SELECT genus, 'ran' AS chimera_status, count(*) FILTER (doc_id IN (SELECT doc_id FROM chimeric)) AS dropped_chimeras, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM chimeric)) AS final FROM one GROUP BY genus""")
def chimera_removal(spark, sf_dir):
    """The cleaning's chimera step after dedup, whose copies add to a sequence's abundance."""
    _, summary = clean.clean(mosaics(spark, sf_dir), Cleaning(min_len=1, max_len=1000, terms=(), chimeras="denovo"))
    return summary.select("genus", "chimera_status", "dropped_chimeras", "final")


# --- dedup -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, genus FROM (SELECT doc_id, lang AS genus, row_number() OVER (PARTITION BY lang, md5(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def exact_dedup(spark, sf_dir):
    """Keyed by a hash of the text, whose letters' case engines fold differently."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("genus"), F.col("doc_id").alias("seq_idx"), F.md5("text").alias("sequence"))
    return clean.exact_dedup(d).select("doc_id", "genus")


@query(f"WITH seq AS ({_SEQ}), {_FRAGMENTS}, m AS (SELECT doc_id - doc_id % 3 AS seq_idx, genus, doc_id, CASE WHEN doc_id % 3 = 2 THEN reverse(translate(substr(b, 11, 90), 'ACGU', 'UGCA')) ELSE substr(b, 11, 90) END AS s FROM (SELECT f.doc_id, f.genus, x.sequence AS b FROM frag f JOIN seq x ON x.doc_id = f.doc_id - f.doc_id % 3)) SELECT doc_id, genus FROM (SELECT doc_id, genus, row_number() OVER (PARTITION BY genus, least(s, reverse(translate(s, 'ACGU', 'UGCA'))) ORDER BY doc_id) AS rn FROM m) WHERE rn = 1")
def dedup_both_strands(spark, sf_dir):
    """Three copies of a sequence, the last of them on the other strand."""
    s = rna(spark, sf_dir)
    base = s.select(F.col("doc_id").alias("b"), F.substring("sequence", 11, 90).alias("whole"))
    of = s.drop("sequence").join(base, F.col("b") == F.col("doc_id") - F.col("doc_id") % 3)
    turned = F.when(F.col("doc_id") % 3 == 2, sequences.reverse_complement(F.col("whole"))).otherwise(F.col("whole"))
    return clean.exact_dedup(of.withColumn("sequence", turned).drop("b", "whole"), "both").select("doc_id", "genus")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1")
def dup_flags(spark, sf_dir):
    return clean.first_wins(load(spark, sf_dir, "documents"), ["text"], ["doc_id"]).select("doc_id", "lang")


@query(f"""
WITH seq AS ({_SEQ}), {_FRAGMENTS}
SELECT doc_id, genus FROM frag a WHERE NOT EXISTS (SELECT 1 FROM frag b WHERE b.genus = a.genus AND (length(b.sequence) > length(a.sequence) OR (length(b.sequence) = length(a.sequence) AND b.doc_id < a.doc_id)) AND (contains(b.sequence, a.sequence) OR contains(b.sequence, reverse(translate(a.sequence, 'ACGU', 'UGCA')))))""")
def nested_removal(spark, sf_dir):
    return clean.drop_nested(fragments(spark, sf_dir)).select("doc_id", "genus")


@query(f"WITH seq AS ({_SEQ}) SELECT doc_id, reverse(translate(sequence, 'ACGU', 'UGCA')) AS rc FROM seq")
def revcomp(spark, sf_dir):
    return rna(spark, sf_dir).select("doc_id", sequences.reverse_complement(F.col("sequence")).alias("rc"))


@query("SELECT p_partkey, regexp_extract(p_type, '([^ ]+)', 1) AS accession FROM part")
def header_accession(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", sequences.accession(F.col("p_type"), F.col("p_partkey")).alias("accession"))


# --- k-mers ----------------------------------------------------------------------------------------------


@query(f"WITH {_windows(3)} SELECT doc_id, kmer, count(*) AS n FROM win GROUP BY ALL")
def kmer_counts(spark, sf_dir):
    return kmers.counts(rna(spark, sf_dir), "doc_id", Kmers(3))


@query(f"WITH {_windows(6)} SELECT doc_id, kmer, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY doc_id), 6) AS freq FROM win GROUP BY doc_id, kmer")
def kmer_freq(spark, sf_dir):
    return kmers.frequencies(rna(spark, sf_dir), "doc_id").select("doc_id", "kmer", "n", r6("freq"))


@query("WITH b AS (SELECT unnest(['A', 'C', 'G', 'U']) AS c, unnest([0, 1, 2, 3]) AS d) SELECT CAST(a.d * 16 + b.d * 4 + e.d AS BIGINT) AS kmer_idx, a.c || b.c || e.c AS kmer FROM b a, b, b e")
def kmer_vocab(spark, sf_dir):
    return kmers.vocabulary(spark, Kmers(3))


@query(f"WITH {_windows(3)} SELECT DISTINCT kmer, CAST((instr('ACGU', substr(kmer, 1, 1)) - 1) * 16 + (instr('ACGU', substr(kmer, 2, 1)) - 1) * 4 + instr('ACGU', substr(kmer, 3, 1)) - 1 AS BIGINT) AS kmer_idx FROM win")
def kmer_index(spark, sf_dir):
    return kmers.counts(rna(spark, sf_dir), "genus", Kmers(3)).select("kmer").distinct().select("kmer", sequences.kmer_index(F.col("kmer")).alias("kmer_idx"))


@query(f"WITH {_windows(6)}, c AS (SELECT genus, kmer, count(*) AS n FROM win GROUP BY ALL) SELECT * FROM (SELECT genus, kmer, n, row_number() OVER (PARTITION BY genus ORDER BY n DESC, kmer) AS rank FROM c) WHERE rank <= 10")
def kmer_top_per_genus(spark, sf_dir):
    return kmers.top_kmers(rna(spark, sf_dir))


@query(f"WITH {_windows(2)}, c AS (SELECT doc_id, (instr('ACGU', substr(kmer, 1, 1)) - 1) * 4 + instr('ACGU', substr(kmer, 2, 1)) - 1 AS i, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM win GROUP BY doc_id, kmer) SELECT doc_id, i AS kmer_idx, round(n * 1.0 / total, 6) AS freq FROM c")
def kmer_matrix(spark, sf_dir):
    """The dense rows, turned back into long form without zeros."""
    m = kmers.matrix(rna(spark, sf_dir), "doc_id", Kmers(2))
    return m.select("doc_id", F.posexplode("features").alias("kmer_idx", "freq")).filter("freq > 0").select("doc_id", F.col("kmer_idx").cast("long").alias("kmer_idx"), r6("freq"))


@query("SELECT doc_id FROM documents WHERE length(text) < 3 OR NOT regexp_matches(translate(upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')), 'T', 'U'), '[ACGU]{6}')")
def zero_kmer_rows(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "-")), "T", "U").alias("sequence"))
    return kmers.without_kmers(d).select("doc_id")


# --- files -----------------------------------------------------------------------------------------------


_NUMBERED = f"seq AS ({_SEQ}), num AS (SELECT genus, row_number() OVER (PARTITION BY genus ORDER BY doc_id) - 1 AS seq_idx, accession || ' ' || doc_id AS header, sequence FROM seq)"


def _written(spark, sf_dir) -> str:
    """A folder of FASTA files, one for each genus."""
    folder = fasta.shared_folder(spark, "fasta")
    s = rna(spark, sf_dir).withColumn("header", F.concat_ws(" ", "accession", "doc_id"))
    fasta.write_files(s, folder)
    return folder


@query(f"WITH {_NUMBERED} SELECT genus, genus || '.clean.fa' AS file, seq_idx, header, sequence FROM num")
def fasta_folder(spark, sf_dir):
    """FASTA files written and read back, their records numbered in order."""
    return fasta.read_folder(spark, _written(spark, sf_dir))


@query(f"WITH {_NUMBERED} SELECT genus || '_' || seq_idx AS sequence_id, genus, regexp_extract(header, '^([^ ]+)', 1) AS accession, header, length(sequence) AS n FROM num")
def fasta_labelled(spark, sf_dir):
    return fasta.labelled(fasta.read_folder(spark, _written(spark, sf_dir))).select("sequence_id", "genus", "accession", "header", F.length("sequence").cast("long").alias("n"))


@query(f"WITH {_NUMBERED} SELECT genus, genus || '.clean.fa' AS file, seq_idx, header, sequence FROM num")
def fasta_source(spark, sf_dir):
    """The same files through the data source, which streams each in one task."""
    folder = _written(spark, sf_dir)
    names = [r[0] for r in rna(spark, sf_dir).select("genus").distinct().collect()]  # a file each
    spark.dataSource.register(fasta.FastaSource)
    return spark.read.format("fasta").option("paths", ",".join(f"{folder}/{n}.clean.fa" for n in sorted(names))).load()


@query(f"WITH {_NUMBERED} SELECT genus, genus || '.clean.fa' AS file, seq_idx, header, sequence FROM num")
def fasta_split(spark, sf_dir):
    """The same files by splits, each of which is a task's."""
    return fasta.read_split(spark, _written(spark, sf_dir))


@query("SELECT lang AS genus, count(*) AS records FROM documents GROUP BY lang")
def fasta_files_written(spark, sf_dir):
    """A file for each genus, as the cleaning step leaves them."""
    return fasta.write_files(rna(spark, sf_dir), fasta.shared_folder(spark, "fasta")).select("genus", "records")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = fasta.shared_folder(spark, "csv")
    load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    return fasta.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query(f"WITH {_LONG} SELECT vec_id, label AS genus, CAST(idx AS BIGINT) AS idx, round(x, 6) AS x FROM long")
def wide_csv(spark, sf_dir):
    """A matrix as CSV with a column for each feature, read back and turned into long form."""
    path = fasta.shared_folder(spark, "wide")
    names = [f"f{i}" for i in range(N_FEATURES)]
    fasta.write_wide_csv(vectors(spark, sf_dir), names, path, ("vec_id", "genus"))
    read = fasta.read_csv(spark, path, f"vec_id long, genus int, {', '.join(f'{n} double' for n in names)}")
    return read.select("vec_id", "genus", F.posexplode(F.array(*names)).alias("idx", "x")).select("vec_id", "genus", F.col("idx").cast("long").alias("idx"), r6("x"))


# --- metadata, joins, splits -----------------------------------------------------------------------------


@query("SELECT lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS sequence_id, lang AS genus, source AS accession, CAST(length(text) AS BIGINT) AS sequence_length FROM documents")
def taxonomy_table(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("genus"), F.col("source").alias("header"), F.regexp_replace("text", "[^\\x00-\\x7F]", "-").alias("sequence"))
    return taxonomy.taxonomy_table(fasta.labelled(fasta.with_ordinal(d, "doc_id"))).select("sequence_id", "genus", "accession", "sequence_length")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def inner_merge(spark, sf_dir):
    return taxonomy.inner_merge(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id")


@query("WITH m AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT * FROM (SELECT 'quality' AS column_name, count(*) FILTER (quality IS NULL) AS missing FROM m UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL) FROM m) WHERE missing > 0")
def left_merge_missing(spark, sf_dir):
    return stats.missing_values(taxonomy.left_merge(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels"), "doc_id"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unmatched_ids(spark, sf_dir):
    return taxonomy.unmatched(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")


_SPLIT = "g AS (SELECT DISTINCT source AS accession FROM documents), o AS (SELECT accession, row_number() OVER (ORDER BY md5(accession || ':42'), accession) AS r, (SELECT count(*) FROM g) AS n FROM g), t AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS nt FROM o), s AS (SELECT accession, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil(CAST(0.2 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE)) * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM t)"


@query(f"WITH {_SPLIT} SELECT accession, split FROM s")
def group_split(spark, sf_dir):
    return split.group_split(rna(spark, sf_dir))


@query(f"WITH {_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT accession) AS groups FROM documents JOIN s ON source = accession GROUP BY split")
def split_sizes(spark, sf_dir):
    s = rna(spark, sf_dir)
    return split.sizes(s.join(split.group_split(s), "accession"))


@query("SELECT source AS accession, count(DISTINCT split) AS splits FROM (SELECT source, CASE WHEN doc_id // 20 % 10 < 6 THEN 'train' WHEN doc_id // 20 % 10 < 8 THEN 'val' ELSE 'test' END AS split FROM documents) GROUP BY source HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    turn = F.floor(F.col("doc_id") / 20) % 10
    by_row = F.when(turn < 6, "train").when(turn < 8, "val").otherwise("test")
    return split.leaks(rna(spark, sf_dir).withColumn("split", by_row))


@query(f"WITH {_SPLIT}, o2 AS (SELECT DISTINCT lang || source AS lang, split FROM documents JOIN s ON source = accession) SELECT l.lang AS genus, p.split FROM (SELECT DISTINCT lang || source AS lang FROM documents) l, (SELECT unnest(['train', 'val', 'test']) AS split) p WHERE NOT EXISTS (SELECT 1 FROM o2 WHERE o2.lang = l.lang AND o2.split = p.split)")
def missing_classes(spark, sf_dir):
    """Classes of one source each, so that each is in one split only."""
    s = rna(spark, sf_dir).withColumn("genus", F.concat("genus", "accession"))
    return split.missing_classes(s.join(split.group_split(s), "accession"))


@query("SELECT min(groups) AS min_groups FROM (SELECT lang, count(DISTINCT source) AS groups FROM documents GROUP BY lang)")
def group_folds_min(spark, sf_dir):
    return split.least_groups(rna(spark, sf_dir))


@query()
def group_folds(spark, sf_dir):
    return split.group_folds(vectors(spark, sf_dir))


# --- profiles --------------------------------------------------------------------------------------------


@query("SELECT label AS genus, count(*) AS n FROM embeddings GROUP BY label")
def class_distribution(spark, sf_dir):
    return stats.class_distribution(vectors(spark, sf_dir))


@query("WITH c AS (SELECT count(*) AS n FROM documents GROUP BY lang), b AS (SELECT max(n) AS largest, min(n) AS smallest FROM c) SELECT largest, smallest, round(largest * 1.0 / smallest, 6) AS ratio, CASE WHEN largest * 1.0 / smallest > 10 THEN 'high' WHEN largest * 1.0 / smallest > 5 THEN 'moderate' ELSE 'balanced' END AS verdict FROM b")
def imbalance(spark, sf_dir):
    return stats.imbalance(rna(spark, sf_dir)).select("largest", "smallest", r6("ratio"), "verdict")


@query("SELECT metric, round(value, 6) AS value FROM (SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'genera', count(DISTINCT lang) FROM documents UNION ALL SELECT 'features', 4096 UNION ALL SELECT 'mean_length', avg(length(text)) FROM documents UNION ALL SELECT 'min_length', min(length(text)) FROM documents UNION ALL SELECT 'max_length', max(length(text)) FROM documents)")
def dataset_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("genus"), F.length("text").alias("sequence_length"))
    return stats.dataset_summary(d, 4096).select("metric", r6("value"))


@query("""WITH c AS (SELECT count(*) AS n FROM documents GROUP BY lang), s AS (SELECT 'rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'genera', count(DISTINCT lang) FROM documents UNION ALL SELECT 'features', 4096 UNION ALL SELECT 'mean_length', avg(length(text)) FROM documents UNION ALL SELECT 'min_length', min(length(text)) FROM documents UNION ALL SELECT 'max_length', max(length(text)) FROM documents),
l AS (SELECT 0 AS part, '' AS metric, 'DATASET DIAGNOSTIC REPORT' AS line UNION ALL SELECT 1, metric, metric || ': ' || printf('%.2f', value) FROM s UNION ALL SELECT 2, 'a', 'Imbalance ratio: ' || printf('%.2f', max(n) * 1.0 / min(n)) FROM c UNION ALL SELECT 2, 'b', 'Number of genera: ' || count(*) FROM c)
SELECT row_number() OVER (ORDER BY part, metric) - 1 AS line_no, line FROM l""")
def summary_text(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("genus"), F.length("text").alias("sequence_length"))
    return stats.summary_text(stats.dataset_summary(d, 4096), stats.class_distribution(d))


@query(f"WITH {_LONG}, {_STATS} SELECT idx, rows, round(mean, 6) AS mean, round(std, 6) AS std, round(variance, 6) AS variance, round(minimum, 6) AS minimum, round(maximum, 6) AS maximum, round(fraction_zero, 6) AS fraction_zero FROM st")
def feature_stats(spark, sf_dir):
    return stats.feature_statistics(vectors(spark, sf_dir)).select("idx", "rows", *map(r6, ("mean", "std", "variance", "minimum", "maximum", "fraction_zero")))


@query(f"WITH {_windows(3)}, c AS (SELECT doc_id, kmer, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS total FROM win GROUP BY doc_id, kmer), v AS (SELECT DISTINCT kmer FROM c), x AS (SELECT kmer, coalesce(n * 1.0 / total, 0) AS f FROM (SELECT v.kmer, s.doc_id FROM v, seq s) k LEFT JOIN c USING (doc_id, kmer)) SELECT kmer AS idx, round(avg(f), 6) AS mean, round(stddev_samp(f), 6) AS std, round(min(f), 6) AS minimum, round(max(f), 6) AS maximum, round(avg(CASE WHEN f = 0 THEN 1.0 ELSE 0.0 END), 6) AS fraction_zero FROM x GROUP BY kmer")
def sparse_feature_stats(spark, sf_dir):
    s = rna(spark, sf_dir)
    f = kmers.frequencies(s, "doc_id", Kmers(3))
    return stats.sparse_statistics(f, s.count(), "kmer", "freq").select("idx", *map(r6, ("mean", "std", "minimum", "maximum", "fraction_zero")))


_ORDERS = "x AS (SELECT 0 AS idx, CAST(o_totalprice AS DOUBLE) AS x FROM orders UNION ALL SELECT 1, 1.0 FROM orders UNION ALL SELECT 2, CASE WHEN o_orderkey % 200 = 0 THEN 0.01 ELSE 0.0 END FROM orders UNION ALL SELECT 3, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END FROM orders), st AS (SELECT CAST(idx AS BIGINT) AS idx, var_samp(x) AS variance, min(x) AS minimum, max(x) AS maximum, avg(CASE WHEN x = 0 THEN 1.0 ELSE 0.0 END) AS fraction_zero FROM x GROUP BY idx)"


def order_features(spark, sf_dir) -> DataFrame:
    """Four features of orders: one that varies, a constant, a rare tiny one and a flag."""
    o = load(spark, sf_dir, "orders")
    return stats.feature_statistics(o.select(F.array("o_totalprice", F.lit(1.0), F.when(F.col("o_orderkey") % 200 == 0, 0.01).otherwise(0.0), (F.col("o_orderstatus") == "F").cast("double")).alias("features")))


@query(f"WITH {_ORDERS} SELECT idx FROM st WHERE minimum = maximum")
def constant_features(spark, sf_dir):
    return stats.constant_features(order_features(spark, sf_dir))


@query(f"WITH {_ORDERS} SELECT idx, round(variance, 9) AS variance FROM st WHERE variance < 1e-5")
def near_zero_variance(spark, sf_dir):
    return stats.near_zero_variance(order_features(spark, sf_dir)).select("idx", F.round("variance", 9).alias("variance"))


@query(f"WITH {_ORDERS} SELECT idx, round(fraction_zero, 6) AS fraction_zero FROM st WHERE fraction_zero >= 0.99")
def sparse_features(spark, sf_dir):
    return stats.sparse_features(order_features(spark, sf_dir)).select("idx", r6("fraction_zero"))


@query(f"""WITH {_ORDERS}, c AS (SELECT count(*) FILTER (minimum = maximum) AS a, count(*) FILTER (variance < 1e-5) AS b, count(*) FILTER (fraction_zero >= 0.99) AS d FROM st),
l AS (SELECT 0 AS o, a AS n, a || ' constant features: remove them' AS line FROM c UNION ALL SELECT 1, b, b || ' features of near-zero variance: consider removing them' FROM c UNION ALL SELECT 2, d, d || ' sparse features: consider a smaller k' FROM c UNION ALL SELECT 3, 3, '3 highly correlated pairs: consider reducing them' UNION ALL SELECT 4, CASE WHEN a + b + d = 0 THEN 1 ELSE 0 END, 'No major recommendations' FROM c)
SELECT row_number() OVER (ORDER BY o) - 1 AS line_no, line FROM l WHERE n > 0""")
def recommendations(spark, sf_dir):
    return stats.report(order_features(spark, sf_dir), 3, Profiling())


@query(f"WITH {_LONG}, {_STATS} SELECT idx, round(variance, 6) AS variance FROM st ORDER BY st.variance DESC, idx LIMIT 10")
def top_variance(spark, sf_dir):
    return stats.top_variance(stats.feature_statistics(vectors(spark, sf_dir)), 10).select("idx", r6("variance"))


@query(f"WITH {_LONG}, t AS (SELECT vec_id, sum(abs(x)) AS s FROM long GROUP BY vec_id) SELECT vec_id, idx, round(abs(x) / s, 6) AS x FROM long JOIN t USING (vec_id)")
def row_normalize(spark, sf_dir):
    """Of absolute values, whose sums aren't near zero."""
    v = vectors(spark, sf_dir).select("vec_id", sequences.normalized(F.transform("features", F.abs)).alias("f"))
    return v.select("vec_id", F.posexplode("f").alias("idx", "x")).select("vec_id", F.col("idx").cast("long").alias("idx"), r6("x"))


@query(f"WITH {_LONG}, t AS (SELECT vec_id, sum(x) AS s FROM long GROUP BY vec_id) SELECT round(min(s), 6) AS min_sum, round(max(s), 6) AS max_sum FROM t")
def row_sums(spark, sf_dir):
    return stats.row_sums(vectors(spark, sf_dir)).select(r6("min_sum"), r6("max_sum"))


@query("SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY round(embedding[1] * 5), round(embedding[2] * 5), round(embedding[3] * 5) ORDER BY vec_id) AS rn FROM embeddings) WHERE rn > 1")
def duplicate_feature_vectors(spark, sf_dir):
    """Of three features in coarse steps, so that there are twins."""
    coarse = F.transform(F.slice("features", 1, 3), lambda x: F.round(x * 5) + 0.0)
    return stats.duplicate_features(vectors(spark, sf_dir).select("vec_id", coarse.alias("features")), "vec_id").select("vec_id")


@query(f"WITH {_LONG}, t AS (SELECT vec_id, sum(abs(x)) AS s FROM long GROUP BY vec_id) SELECT idx, round(var_samp(abs(x) / s), 9) AS variance FROM long JOIN t USING (vec_id) GROUP BY idx")
def normalized_variance(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.transform("features", F.abs).alias("features"))
    return stats.normalized_variance(v).select("idx", F.round("variance", 9).alias("variance"))


@query("SELECT doc_id, CAST(nullif(n_chars % 7, 0) AS DOUBLE) AS x, n_chars % 7 = 0 AS missing FROM documents")
def missing_features(spark, sf_dir):
    """Rows whose features miss a value."""
    x = F.when(F.col("n_chars") % 7 != 0, (F.col("n_chars") % 7).cast("double"))
    return load(spark, sf_dir, "documents").select("doc_id", x.alias("x"), sequences.has_missing(F.array(x)).alias("missing"))


# --- correlation -----------------------------------------------------------------------------------------


@query(f"WITH {_LONG}, {_PAIRS} SELECT f1, f2, round(r, 6) AS r FROM prs WHERE abs(r) > {CORRELATED}")
def corr_pairs(spark, sf_dir):
    return correlation.strong(correlation.pairs(vectors(spark, sf_dir)), CORRELATED).select("f1", "f2", r6("r"))


@query(f"WITH {_LONG}, {_PAIRS} SELECT f1, f2, round(r, 6) AS r FROM prs")
def corr_pairs_long_all(spark, sf_dir):
    """From the long form, without a matrix on the driver."""
    long = vectors(spark, sf_dir).select("vec_id", F.posexplode("features").alias("idx", "x")).select("vec_id", F.col("idx").cast("long").alias("idx"), "x")
    return correlation.long_pairs(long, load(spark, sf_dir, "embeddings").count(), "vec_id", "idx", "x").select("f1", "f2", r6("r"))


@query(f"WITH {_LONG}, {_PAIRS} SELECT f1, f2, round(r, 6) AS r FROM prs")
def corr_blocks(spark, sf_dir):
    """From strips of products; blocks of 24, so that 64 features make three."""
    return blocks.pairs(vectors(spark, sf_dir), block=24).select("f1", "f2", r6("r"))


@query(f"WITH {_LONG}, {_PAIRS} SELECT CAST(least(floor((r + 1.0) / (2.0 / 60)) + 1, 60) AS BIGINT) AS bin, count(*) AS n FROM prs GROUP BY 1")
def corr_histogram(spark, sf_dir):
    return correlation.histogram(correlation.pairs(vectors(spark, sf_dir)))


@query(f"WITH {_LONG}, {_PAIRS}, e AS (SELECT f1 AS idx, abs(r) AS a FROM prs UNION ALL SELECT f2, abs(r) FROM prs) SELECT idx, round(sum(a) / {N_FEATURES}, 6) AS mean_abs FROM e GROUP BY idx")
def mean_abs_corr(spark, sf_dir):
    return correlation.mean_absolute(correlation.pairs(vectors(spark, sf_dir)), N_FEATURES).select("idx", r6("mean_abs"))


@query(f"WITH {_LONG}, {_PAIRS}, e AS (SELECT * FROM prs WHERE abs(r) > {DEGREE}) SELECT idx, count(*) AS degree FROM (SELECT f1 AS idx FROM e UNION ALL SELECT f2 FROM e) GROUP BY idx")
def corr_network_degree(spark, sf_dir):
    return correlation.network_degree(correlation.pairs(vectors(spark, sf_dir)), DEGREE)


_RANKS = "rk AS (SELECT vec_id, idx, rank() OVER (PARTITION BY idx ORDER BY x) + (count(*) OVER (PARTITION BY idx, x) - 1) / 2.0 AS x FROM long), sp AS (SELECT a.idx AS f1, b.idx AS f2, corr(a.x, b.x) AS r FROM rk a JOIN rk b ON a.vec_id = b.vec_id AND a.idx < b.idx GROUP BY a.idx, b.idx)"


@query(f"WITH {_LONG}, {_RANKS} SELECT f1, f2, round(r, 6) AS r FROM sp WHERE abs(r) > {CORRELATED}")
def corr_spearman(spark, sf_dir):
    return correlation.strong(correlation.pairs(vectors(spark, sf_dir), method="spearman"), CORRELATED).select("f1", "f2", r6("r"))


@query(f"WITH {_LONG}, {_RANKS} SELECT f1, f2, round(r, 6) AS r FROM sp")
def rank_corr_blocks(spark, sf_dir):
    """Spearman's from ranks that ranges of values make, by blocks."""
    return blocks.pairs(blocks.ranked(vectors(spark, sf_dir), "vec_id"), block=24).select("f1", "f2", r6("r"))


def _greedy(pairs: str, cutoff: float, n: str) -> str:
    """Pairs in order, one after the other: gone collects the dropped features, log what was dropped for what."""
    return f"""means AS (SELECT idx, sum(a) / {n} AS m FROM (SELECT f1 AS idx, abs(r) AS a FROM {pairs} UNION ALL SELECT f2, abs(r) FROM {pairs}) GROUP BY idx),
cand AS (SELECT row_number() OVER (ORDER BY abs(r) DESC, f2, f1) AS k, f1, f2, abs(r) AS r, x.m >= y.m AS first_goes FROM {pairs} JOIN means x ON x.idx = f1 JOIN means y ON y.idx = f2 WHERE abs(r) > {cutoff}),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST([] AS STRUCT(d BIGINT, s BIGINT, r DOUBLE)[]) AS log
      UNION ALL SELECT c.k, CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN gone ELSE list_append(gone, CASE WHEN first_goes THEN f1 ELSE f2 END) END,
             CASE WHEN list_contains(gone, f1) OR list_contains(gone, f2) THEN log ELSE list_append(log, {{'d': CASE WHEN first_goes THEN f1 ELSE f2 END, 's': CASE WHEN first_goes THEN f2 ELSE f1 END, 'r': c.r}}) END
      FROM g JOIN cand c ON c.k = g.k + 1),
done AS (SELECT gone, log FROM g ORDER BY k DESC LIMIT 1)"""


@query(f"WITH RECURSIVE {_LONG}, {_PAIRS}, {_greedy('prs', CORRELATED, N_FEATURES)} SELECT CAST(e.d AS INTEGER) AS dropped_feature, CAST(e.s AS INTEGER) AS kept_feature, round(e.r, 6) AS correlation FROM (SELECT unnest(log) AS e FROM done)")
def greedy_drop(spark, sf_dir):
    log = correlation.greedy_drop(correlation.matrix(vectors(spark, sf_dir)), CORRELATED)
    return spark.createDataFrame(log, "dropped_feature int, kept_feature int, correlation double").withColumn("correlation", F.round("correlation", 6))


_SPLIT_V = "gv AS (SELECT DISTINCT vec_id % 50 AS accession FROM embeddings), ov AS (SELECT accession, row_number() OVER (ORDER BY md5(accession || ':42'), accession) AS r, (SELECT count(*) FROM gv) AS n FROM gv), tv AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS nt FROM ov), sv AS (SELECT accession, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil(CAST(0.2 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE)) * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM tv)"
_TRAIN = "prt AS (SELECT a.idx AS f1, b.idx AS f2, corr(a.x, b.x) AS r FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.idx < b.idx JOIN sv ON sv.accession = a.vec_id % 50 AND split = 'train' GROUP BY a.idx, b.idx)"


@query(f"WITH RECURSIVE {_LONG}, {_SPLIT_V}, {_TRAIN}, {_greedy('prt', 0.15, N_FEATURES)} SELECT vec_id, CAST(idx AS BIGINT) AS idx, split, round(x, 6) AS x FROM long JOIN sv ON sv.accession = vec_id % 50, done WHERE NOT list_contains(gone, idx)")
def reduced_features(spark, sf_dir):
    """The reduced matrix in long form, with the numbers of the features that training rows say to keep."""
    from ..config import Reducing

    v = vectors(spark, sf_dir)
    reduced, kept, _ = correlation.reduce_features(v.join(split.group_split(v), "accession"), Reducing(cutoff=0.15))
    long = reduced.select("vec_id", "split", F.posexplode("features").alias("at", "x"))
    return long.select("vec_id", F.array(*map(F.lit, kept))[F.col("at")].cast("long").alias("idx"), "split", r6("x"))


@query(f"WITH {_LONG}, {_PAIRS} SELECT * FROM (SELECT f1, f2, round(r, 6) AS r, row_number() OVER (ORDER BY abs(r) DESC, f1, f2) AS rank FROM prs) WHERE rank <= 50")
def corr_pairs_by_strength(spark, sf_dir):
    """The fifty strongest pairs, a report."""
    from pyspark.sql.window import Window

    top = correlation.pairs(vectors(spark, sf_dir)).orderBy(F.desc(F.abs("r")), "f1", "f2").limit(50)
    return top.select("f1", "f2", r6("r"), F.row_number().over(Window.orderBy(F.desc(F.abs("r")), "f1", "f2")).cast("long").alias("rank"))


@query(f"WITH {_ORDERS} SELECT idx FROM st WHERE minimum < maximum")
def varying_features(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    rows = o.select(F.array("o_totalprice", F.lit(1.0), F.when(F.col("o_orderkey") % 200 == 0, 0.01).otherwise(0.0), (F.col("o_orderstatus") == "F").cast("double")).alias("features"))
    return spark.createDataFrame([(i,) for i in correlation.varying(rows)], "idx long")


@query(f"WITH {_LONG} SELECT vec_id, CASE idx WHEN 5 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS at, round(x, 6) AS x FROM long WHERE idx IN (5, 2, 40)")
def column_subset(spark, sf_dir):
    """Three features in an order of their own."""
    taken = correlation.take(vectors(spark, sf_dir), [5, 2, 40]).select("vec_id", F.posexplode("features").alias("at", "x"))
    return taken.select("vec_id", F.col("at").cast("int").alias("at"), r6("x"))


@query(f"WITH {_SPLIT_V} SELECT vec_id, label AS genus, vec_id % 50 AS accession, split FROM embeddings JOIN sv ON sv.accession = vec_id % 50")
def manifest_merge(spark, sf_dir):
    v = vectors(spark, sf_dir)
    m = v.select("vec_id", "accession").join(split.group_split(v), "accession")
    return taxonomy.merge_manifest(v, m, "vec_id").select("vec_id", "genus", "accession", "split")


@query("WITH s AS (SELECT *, CASE WHEN (vec_id % 50) % 5 = 0 THEN 'test' WHEN (vec_id % 50) % 5 = 1 THEN 'val' ELSE 'train' END AS split FROM embeddings) SELECT split, count(*) AS rows, count(DISTINCT vec_id % 50) AS groups FROM s GROUP BY split")
def given_split(spark, sf_dir):
    """A split that comes with the table, checked for unknown labels and leaks."""
    turn = F.col("accession") % 5
    v = vectors(spark, sf_dir).withColumn("split", F.when(turn == 0, "test").when(turn == 1, "val").otherwise("train"))
    return split.sizes(split.check_split(v))


@query("SELECT 5 AS folds, (SELECT count(DISTINCT vec_id % 50) FROM embeddings) AS groups, 0 AS groups_in_several_folds, 0 AS folds_without_a_class")
def group_folds_checked(spark, sf_dir):
    """What holds for any even deal: every group in one fold, every class in every fold."""
    v = vectors(spark, sf_dir)
    folds = split.group_folds(v)
    cells = v.join(folds, "accession").select("genus", "fold").distinct().count()
    one = folds.agg(F.count_distinct("fold").alias("k"), F.count_distinct("accession").alias("groups"), F.count("*").alias("rows")).first()
    missing = one["k"] * v.select("genus").distinct().count() - cells
    return spark.createDataFrame([(one["k"], one["groups"], one["rows"] - one["groups"], missing)], "folds int, groups long, groups_in_several_folds int, folds_without_a_class int")


@query("SELECT round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM customer")
def cv_summary(spark, sf_dir):
    """Mean and population deviation, of balances in place of scores."""
    s = evaluate.cv_summary(load(spark, sf_dir, "customer").select(F.col("c_acctbal").alias("score")))
    return s.select(r6("mean"), r6("std"))


_LINKAGE = f"""
d AS (SELECT f1, f2, 1 - abs(r) AS d FROM prs),
run(step, cl, x, y, h) AS (
  SELECT -1, range({N_FEATURES}), -1::BIGINT, -1::BIGINT, 0::DOUBLE
  UNION ALL
  SELECT step + 1, list_transform(cl, lambda c: CASE WHEN c = m.x OR c = m.y THEN {N_FEATURES} + step + 1 ELSE c END), m.x, m.y, m.h
  FROM run, LATERAL (SELECT least(cl[f1 + 1], cl[f2 + 1]) AS x, greatest(cl[f1 + 1], cl[f2 + 1]) AS y, avg(d) AS h FROM d WHERE cl[f1 + 1] <> cl[f2 + 1] GROUP BY 1, 2 ORDER BY h, x, y LIMIT 1) m
  WHERE step < {N_FEATURES - 2})"""


@query(f"WITH RECURSIVE {_LONG}, {_PAIRS}, {_LINKAGE} SELECT step, CAST(x AS INTEGER) AS first, CAST(y AS INTEGER) AS second, round(h, 6) AS height FROM run WHERE step >= 0")
def dendrogram(spark, sf_dir):
    """Merges by a chain of nearest neighbours; the SQL takes the nearest two clusters anew at each step."""
    merges = correlation.dendrogram(correlation.matrix(vectors(spark, sf_dir)))
    return spark.createDataFrame(merges, "step int, first int, second int, height double").withColumn("height", F.round("height", 6))


@query(f"WITH {_LONG}, {_STATS}, top AS (SELECT idx FROM st ORDER BY variance DESC, idx LIMIT 10) SELECT a.idx AS f1, b.idx AS f2, round(abs(corr(a.x, b.x)), 6) AS r FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.idx < b.idx WHERE a.idx IN (SELECT idx FROM top) AND b.idx IN (SELECT idx FROM top) GROUP BY a.idx, b.idx")
def heatmap_cells(spark, sf_dir):
    v = vectors(spark, sf_dir)
    top = F.broadcast(stats.top_variance(stats.feature_statistics(v), 10).select("idx"))
    p = correlation.pairs(v)
    return p.join(top.withColumnRenamed("idx", "f1"), "f1").join(top.withColumnRenamed("idx", "f2"), "f2").select("f1", "f2", F.round(F.abs("r"), 6).alias("r"))


# --- scaling, models, evaluation -------------------------------------------------------------------------


@query(f"WITH {_LONG}, m AS (SELECT idx, avg(x) AS a, stddev_pop(x) AS s FROM long GROUP BY idx) SELECT vec_id, idx, round((x - a) / s, 6) AS x FROM long JOIN m USING (idx)")
def standardize(spark, sf_dir):
    s = embed.standardize(vectors(spark, sf_dir))
    return s.select("vec_id", F.posexplode("features").alias("idx", "x")).select("vec_id", F.col("idx").cast("long").alias("idx"), r6("x"))


@query()
def pca_scores(spark, sf_dir):
    scores, _ = embed.pca(embed.standardize(vectors(spark, sf_dir)))
    return scores.select("vec_id", "genus", r6("PC1"), r6("PC2"))


@query("WITH c AS (SELECT abs(corr(CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE))) AS r FROM embeddings) SELECT 1 AS component, round((1 + r) / 2, 6) AS ratio FROM c UNION ALL SELECT 2, round((1 - r) / 2, 6) FROM c")
def explained_variance(spark, sf_dir):
    """Of two scaled features, whose shares follow from their correlation."""
    two = vectors(spark, sf_dir).select("vec_id", F.slice("features", 1, 2).alias("features"))
    _, ratios = embed.pca(embed.standardize(two))
    return spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(ratios, 1)], "component int, ratio double")


_SCALED = "m AS (SELECT idx, avg(x) AS a, stddev_pop(x) AS s FROM long GROUP BY idx), z AS (SELECT vec_id, idx, (x - a) / s AS x FROM long JOIN m USING (idx))"


@query(f"WITH {_LONG}, {_SCALED} SELECT vec_id, round(sum(x * x), 6) AS norm FROM z GROUP BY vec_id")
def pca_checked(spark, sf_dir):
    """All components turn the scaled rows without changing any row's length."""
    scores, _ = embed.pca(embed.standardize(vectors(spark, sf_dir)), N_FEATURES)
    return scores.select("vec_id", F.round(sum(F.col(f"PC{i + 1}") ** 2 for i in range(N_FEATURES)), 6).alias("norm"))


@query(f"WITH {_LONG}, {_PAIRS} SELECT {N_FEATURES}.0::DOUBLE AS total, round({N_FEATURES} + 2 * sum(r * r), 6) AS squares, true AS falls, true AS uncorrelated FROM prs")
def pca_variances(spark, sf_dir):
    """Components' variances add up to the features', their squares to those of all correlations; they fall, and no two components are correlated."""
    names = [f"PC{i + 1}" for i in range(N_FEATURES)]
    scores, _ = embed.pca(embed.standardize(vectors(spark, sf_dir)), N_FEATURES)
    v = scores.select("vec_id", F.array(*names).alias("features"))
    variance = stats.feature_statistics(v).select("idx", (F.col("variance") * (F.col("rows") - 1) / F.col("rows")).alias("v"))
    by_idx = F.transform(F.array_sort(F.collect_list(F.struct("idx", "v"))), lambda s: s["v"])  # one entry a component
    falls = F.forall(F.zip_with(F.slice("a", 1, N_FEATURES - 1), F.slice("a", 2, N_FEATURES - 1), lambda x, y: x >= y), lambda x: x)
    most = correlation.pairs(v).agg((F.max(F.abs("r")) < 1e-6).alias("uncorrelated"))
    return variance.agg(by_idx.alias("a")).crossJoin(F.broadcast(most)).select(F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squares"), falls.alias("falls"), "uncorrelated")


@query(f"WITH {_LONG}, d AS (SELECT a.vec_id AS id, b.vec_id AS other, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM long a JOIN long b ON a.idx = b.idx AND a.vec_id <> b.vec_id GROUP BY a.vec_id, b.vec_id) SELECT id, other, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM d) WHERE r <= 15")
def neighbour_graph(spark, sf_dir):
    """The 15 nearest of each row."""
    v = vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("features").alias("x"))
    return layout.neighbours(stored(v, "vectors"), 15).select("id", "other", r6("d"))


@query()
def tsne_layout(spark, sf_dir):
    """Of all rows; those that aren't landmarks are placed among them, and all are moved together."""
    return embed.tsne(embed.standardize(vectors(spark, sf_dir)), key="vec_id")


@query()
def umap_layout(spark, sf_dir):
    return embed.umap(embed.standardize(vectors(spark, sf_dir)), key="vec_id")


@query("SELECT CAST(label AS BIGINT) AS genus, dense_rank() OVER (ORDER BY label) - 1 AS idx FROM (SELECT DISTINCT label FROM embeddings)")
def label_index(spark, sf_dir):
    return embed.label_index(vectors(spark, sf_dir)).withColumn("genus", F.col("genus").cast("long"))


@query("SELECT vec_id, unnest(range(10)) AS class, CASE WHEN unnest(range(10)) = label THEN 1 ELSE 0 END AS hot FROM embeddings")
def one_hot(spark, sf_dir):
    h = vectors(spark, sf_dir).select("vec_id", F.posexplode(sequences.one_hot(F.col("genus"), 10)).alias("class", "hot"))
    return h.select("vec_id", F.col("class").cast("long").alias("class"), "hot")


@query("SELECT DISTINCT translate(p_type, ' /', '__') AS name FROM part")
def safe_names(spark, sf_dir):
    return load(spark, sf_dir, "part").select(sequences.safe_name(F.col("p_type")).alias("name")).distinct()


def predictions(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("pred"))


_CONFUSION = "seen AS (SELECT quality AS y, toxic AS pred, count(*) AS n FROM labels GROUP BY ALL), l AS (SELECT y AS l FROM seen UNION SELECT pred FROM seen), conf AS (SELECT a.l AS y, b.l AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN seen ON seen.y = a.l AND seen.pred = b.l), cls AS (SELECT l AS label, sum(n) FILTER (y = l AND pred = l) AS tp, sum(n) FILTER (y = l) AS support, sum(n) FILTER (pred = l) AS predicted FROM conf, l GROUP BY l), prf AS (SELECT label, CASE WHEN predicted = 0 THEN 0.0 ELSE tp * 1.0 / predicted END AS precision, CASE WHEN support = 0 THEN 0.0 ELSE tp * 1.0 / support END AS recall, CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END AS f1, support FROM cls)"


@query(f"WITH {_CONFUSION} SELECT y, pred, CAST(n AS BIGINT) AS n FROM conf")
def confusion(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir))


@query(f"WITH {_CONFUSION} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM prf")
def prf_per_class(spark, sf_dir):
    return evaluate.per_class(evaluate.confusion(predictions(spark, sf_dir))).select("label", r6("precision"), r6("recall"), r6("f1"), "support")


_SUMMARY = "s AS (SELECT (SELECT sum(n) FILTER (y = pred) * 1.0 / sum(n) FROM conf) AS accuracy, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf, sum(support) AS total FROM prf)"


@query(f"WITH {_CONFUSION}, {_SUMMARY} SELECT round(accuracy, 6) AS accuracy, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1, round(wp, 6) AS weighted_precision, round(wr, 6) AS weighted_recall, round(wf, 6) AS weighted_f1 FROM s")
def accuracy_macro_weighted(spark, sf_dir):
    s = evaluate.summary(evaluate.confusion(predictions(spark, sf_dir)))
    return s.select(*map(r6, s.columns))


@query(f"WITH {_CONFUSION}, {_SUMMARY} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(support, 6) AS support FROM (SELECT CAST(label AS VARCHAR) AS label, precision, recall, f1, CAST(support AS DOUBLE) AS support FROM prf UNION ALL SELECT 'accuracy', accuracy, accuracy, accuracy, accuracy FROM s UNION ALL SELECT 'macro avg', mp, mr, mf, total FROM s UNION ALL SELECT 'weighted avg', wp, wr, wf, total FROM s)")
def prf_report(spark, sf_dir):
    return evaluate.report(evaluate.confusion(predictions(spark, sf_dir))).select("label", r6("precision"), r6("recall"), r6("f1"), r6("support"))


def scores(spark, sf_dir) -> DataFrame:
    """Each segment against the others, by balance."""
    c = load(spark, sf_dir, "customer")
    segments = F.broadcast(c.select(F.col("c_mktsegment").alias("class")).distinct())
    return c.crossJoin(segments).select("class", F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") == F.col("class")).cast("long").alias("positive"))


_ROC = "sc AS (SELECT s.c_mktsegment AS class, c.c_acctbal AS score, CASE WHEN c.c_mktsegment = s.c_mktsegment THEN 1 ELSE 0 END AS positive FROM customer c, (SELECT DISTINCT c_mktsegment FROM customer) s), t AS (SELECT class, score, sum(positive) AS p, sum(1 - positive) AS q FROM sc GROUP BY class, score), pts AS (SELECT class, score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, p, q, sum(p) OVER (PARTITION BY class) AS pp, sum(q) OVER (PARTITION BY class) AS nn FROM t WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_ROC} SELECT class, score, tp, fp FROM pts")
def roc_points(spark, sf_dir):
    return evaluate.roc_points(scores(spark, sf_dir)).select("class", "score", "tp", "fp")


@query(f"WITH {_ROC} SELECT class, round(sum(q * (tp - p / 2.0)) / (max(pp) * max(nn)), 6) AS auc FROM pts GROUP BY class")
def auc_per_class(spark, sf_dir):
    return evaluate.auc(evaluate.roc_points(scores(spark, sf_dir))).select("class", r6("auc"))


@query("WITH m AS (SELECT avg(l_extendedprice) AS a FROM lineitem) SELECT round(1 - sum((l_extendedprice - l_quantity * 1500) * (l_extendedprice - l_quantity * 1500)) / sum((l_extendedprice - a) * (l_extendedprice - a)), 6) AS r2 FROM lineitem, m")
def r2(spark, sf_dir):
    x = load(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return evaluate.r2(x, "y", "p").select(r6("r2"))


@query("WITH p AS (SELECT quality AS y, CASE WHEN toxic = 1 THEN [0.7, 0.3] ELSE [0.2, 0.8] END AS proba FROM labels), l AS (SELECT c AS class, CASE WHEN y = c THEN 1.0 ELSE 0.0 END AS t, proba[c + 1] AS s FROM p, (SELECT unnest([0, 1]) AS c)), m AS (SELECT class, avg(t) AS m FROM l GROUP BY class) SELECT round(avg(r), 6) AS r2 FROM (SELECT 1 - sum((t - s) * (t - s)) / sum((t - m) * (t - m)) AS r FROM l JOIN m USING (class) GROUP BY class)")
def r2_probabilities(spark, sf_dir):
    toxic = F.when(F.col("pred") == 1, F.array(F.lit(0.7), F.lit(0.3))).otherwise(F.array(F.lit(0.2), F.lit(0.8)))
    return evaluate.r2_probabilities(predictions(spark, sf_dir).withColumn("proba", toxic)).select(r6("r2"))


@query("SELECT label AS genus, round(avg(e1), 6) AS mean_x, round(avg(e2), 6) AS mean_y, round(var_samp(e1), 6) AS var_x, round(var_samp(e2), 6) AS var_y, round(covar_samp(e1, e2), 6) AS cov_xy, count(*) AS n FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2 FROM embeddings) GROUP BY label")
def class_ellipses(spark, sf_dir):
    """Of the first two features in place of the first two components."""
    v = vectors(spark, sf_dir).select("genus", F.col("features")[0].alias("PC1"), F.col("features")[1].alias("PC2"))
    e = embed.ellipses(v)
    return e.select("genus", *map(r6, ("mean_x", "mean_y", "var_x", "var_y", "cov_xy")), "n")


@query("WITH c AS (SELECT lang AS genus, count(*) AS n FROM documents GROUP BY lang) SELECT genus, round((SELECT sum(n) FROM c) * 1.0 / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def class_weights(spark, sf_dir):
    return evaluate.class_weights(rna(spark, sf_dir)).select("genus", r6("weight"))


def _prepared(spark, sf_dir) -> DataFrame:
    v = vectors(spark, sf_dir)
    return models.prepare(v.join(split.group_split(v), "accession"))


@query()
def rf_fit(spark, sf_dir):
    """Test predictions of a forest fitted on the training split."""
    from ..config import Forest

    rows = _prepared(spark, sf_dir)
    model = models.train("random_forest", rows.filter("split = 'train'"), forest=Forest())
    return models.predict(model, rows.filter("split = 'test'")).select("vec_id", "y", "pred", "proba")


@query()
def boosted_fit(spark, sf_dir):
    """Test predictions of boosted trees of the default size, stopped early by the validation split."""
    from ..config import Boosting

    rows = _prepared(spark, sf_dir)
    part = lambda name: stored(rows.filter(F.col("split") == name), "boosted-rows")
    model = models.train("boosted_trees", part("train"), part("val"), boosting=Boosting())
    return models.predict(model, rows.filter("split = 'test'")).select("vec_id", "y", "pred", "proba")


@query()
def shap_top_features(spark, sf_dir):
    from ..config import Forest

    rows = _prepared(spark, sf_dir)
    model = models.train("random_forest", rows.filter("split = 'train'"), forest=Forest())
    test = rows.filter("split = 'test'")
    values = explain.explain(test, explain.trees_of(spark, model), [f"f{i}" for i in range(N_FEATURES)], "vec_id")
    return explain.strongest(values, test.count())


@query()
def reduced_matrix(spark, sf_dir):
    """Features that training rows say to keep, for all rows."""
    from ..config import Reducing

    v = vectors(spark, sf_dir)
    reduced, _, _ = correlation.reduce_features(v.join(split.group_split(v), "accession"), Reducing(cutoff=0.15))
    return reduced.select("vec_id", "genus", "split", "features")


