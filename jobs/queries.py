"""The jobs as queries over the driver's tables, and the SQL that checks them.

Each runs its job twice into one new folder of the shared ones and returns all that is there after the second run.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.sources.fasta import shared_folder

from . import intake, release
from .records import settings

HERE = Path(__file__).parent


def job1_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_folder(spark, "release")
    for _ in range(2):
        release.build(spark, f"{sf_dir}/documents.parquet", target, settings(f"{HERE}/release.toml"))
    return release.output(spark, target).select("seq_idx", "genus", "drop_reason", "split", "accession", "sequence_length", F.array_join("kmers", ",").alias("kmers"))


def job2_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = shared_folder(spark, "intake")
    for _ in range(2):
        intake.run(spark, f"{sf_dir}/{{documents.parquet}}", target, settings(f"{HERE}/intake.toml"))
    return intake.output(spark, target).select("what", "genus", "name", "decision", "n", F.round("share", 6).alias("share"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_release, job2_intake)}

_JUDGED = """
seq AS (SELECT doc_id, lang AS genus, source AS accession, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGUACGUACGUACGUACGUACGUAC') AS s FROM documents),
judged AS (SELECT *, length(s) AS len, CASE WHEN contains(accession, '7') THEN 'ambiguous_label' WHEN length(s) < 200 OR length(s) > 20000 THEN 'length_out_of_range' ELSE 'pass' END AS reason FROM seq),
firsts AS (SELECT genus, s, min(doc_id) AS doc_id FROM judged WHERE reason = 'pass' GROUP BY genus, s)"""
_TRIPLES = "letters AS (SELECT doc_id, genus, unnest(string_split(s, '')) AS c, unnest(range(length(s))) AS i FROM {of}), triples AS (SELECT doc_id, genus, c || lead(c, 1) OVER w || lead(c, 2) OVER w AS kmer FROM letters WINDOW w AS (PARTITION BY doc_id ORDER BY i))"
_VOCABULARY = "b AS (SELECT unnest(['A', 'C', 'G', 'U']) AS c), v AS (SELECT x.c || y.c || z.c AS kmer FROM b x, b y, b z)"

ORACLES: dict[str, str] = {
    "job1_release": f"""
WITH {_JUDGED},
firm AS (SELECT f.*, accession, len FROM firsts f JOIN judged USING (doc_id)),
kept AS (SELECT * FROM firm a WHERE NOT EXISTS (SELECT 1 FROM firm b WHERE b.genus = a.genus AND (b.len > a.len OR (b.len = a.len AND b.doc_id < a.doc_id)) AND (contains(b.s, a.s) OR contains(b.s, reverse(translate(a.s, 'ACGU', 'UGCA')))))),
g AS (SELECT DISTINCT accession FROM kept), o AS (SELECT accession, row_number() OVER (ORDER BY md5(accession || ':42'), accession) AS r, (SELECT count(*) FROM g) AS n FROM g), t AS (SELECT *, ceil(CAST(0.2 AS DOUBLE) * n) AS nt FROM o),
sp AS (SELECT accession, CASE WHEN r <= nt THEN 'test' WHEN r <= nt + ceil(CAST(0.2 AS DOUBLE) / (1 - CAST(0.2 AS DOUBLE)) * (n - nt)) THEN 'val' ELSE 'train' END AS split FROM t),
{_TRIPLES.format(of="kept")}, {_VOCABULARY},
c AS (SELECT doc_id, kmer, count(*) AS n FROM triples WHERE kmer IS NOT NULL GROUP BY ALL),
arrays AS (SELECT k.doc_id, string_agg(CAST(coalesce(c.n, 0) AS VARCHAR), ',' ORDER BY v.kmer) AS kmers FROM kept k CROSS JOIN v LEFT JOIN c ON c.doc_id = k.doc_id AND c.kmer = v.kmer GROUP BY k.doc_id)
SELECT j.doc_id AS seq_idx, j.genus, CASE WHEN reason <> 'pass' THEN reason WHEN f.doc_id IS NULL THEN 'duplicate' WHEN k.doc_id IS NULL THEN 'nested' ELSE 'pass' END AS drop_reason,
       sp.split, k.accession, k.len AS sequence_length, a.kmers
FROM judged j LEFT JOIN firsts f USING (doc_id) LEFT JOIN kept k USING (doc_id) LEFT JOIN sp ON sp.accession = k.accession LEFT JOIN arrays a USING (doc_id)""",
    "job2_intake": f"""
WITH {_JUDGED}, {_TRIPLES.format(of="firsts")},
c AS (SELECT genus, kmer, count(*) AS n FROM triples WHERE kmer IS NOT NULL GROUP BY ALL)
SELECT 'record' AS what, j.genus, CAST(j.doc_id AS VARCHAR) AS name, CASE WHEN reason <> 'pass' THEN reason WHEN f.doc_id IS NULL THEN 'duplicate' ELSE 'admitted' END AS decision, len AS n, CAST(NULL AS DOUBLE) AS share
FROM judged j LEFT JOIN firsts f USING (doc_id)
UNION ALL
SELECT 'kmer', genus, kmer, NULL, n, round(n / sum(n) OVER (PARTITION BY genus), 6) FROM c""",
}
