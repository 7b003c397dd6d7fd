import json
import random

import pytest

from kmerloom.operators import clean, taxonomy
from kmerloom.sources import fasta


@pytest.fixture()
def folder(tmp_path):
    files = {"Alpha.fasta": ">a1 first\nACGU\n\nacg\n>\nAC\n>e\n", "Beta.fa": "junk\n>z\nAA\n", "Gamma.clean.fa": ">g\nCC\n", "note.txt": ">n\nA\n", "Eps.FASTA": ">n\nA\n", "Win.fa": ">w x\r\nAC\r\nGU\r\n"}
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/Delta.fa").write_text(">d\nA\n")
    return str(tmp_path)


def test_folder(spark, folder):
    rows = {r["sequence_id"]: r for r in fasta.labelled(fasta.read_folder(spark, folder)).collect()}
    assert set(rows) == {"Alpha_0", "Alpha_1", "Alpha_2", "Beta_0", "Gamma_0", "Win_0"}
    assert (rows["Alpha_0"]["accession"], rows["Alpha_0"]["sequence"], rows["Alpha_0"]["header"]) == ("a1", "ACGUACG", "a1 first")
    assert (rows["Alpha_1"]["accession"], rows["Alpha_1"]["header"]) == ("seq1", "")
    assert rows["Alpha_2"]["sequence"] == ""
    assert rows["Win_0"]["sequence"] == "ACGU"
    assert "Gamma.clean_0" in {r[0] for r in fasta.labelled(fasta.read_folder(spark, folder, compat=True)).select("sequence_id").collect()}


def test_empty_folder(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        fasta.read_folder(spark, str(tmp_path))


def test_data_source_agrees(spark, folder):
    spark.dataSource.register(fasta.FastaSource)
    paths = ",".join(f"{folder}/{n}" for n in ("Alpha.fasta", "Beta.fa", "Gamma.clean.fa", "Win.fa"))
    streamed = spark.read.format("fasta").option("paths", paths).load()
    key = lambda df: sorted(map(tuple, df.select("genus", "seq_idx", "header", "sequence").collect()))
    assert key(streamed) == key(fasta.read_folder(spark, folder))


def test_same_genus_twice(spark, tmp_path):
    (tmp_path / "A.fa").write_text(">x\nAC\n")
    (tmp_path / "A.fasta").write_text(">y\nGU\n")
    assert fasta.duplicated_ids(fasta.labelled(fasta.read_folder(spark, str(tmp_path)))).count() == 1


def test_write_and_read_again(spark, tmp_path):
    rows = [("G", 0, "h0 x", "ACGU" * 40), ("G", 1, "h1", ""), ("H", 0, "k", "A" * 60)]
    df = spark.createDataFrame(rows, "genus string, seq_idx long, header string, sequence string")
    fasta.write_folder(df, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out/genus=G").glob("part*"))
    assert max(map(len, text.split("\n"))) == 60
    back = []
    for entry in text.split(">")[1:]:
        head, _, body = entry.partition("\n")
        back.append((head, body.replace("\n", "")))
    assert back == [("h0 x", "ACGU" * 40), ("h1", "")]


def test_exports(spark, tmp_path):
    f = spark.createDataFrame([("s", "g", [0.5, 0.5])], "sequence_id string, genus string, features array<double>")
    fasta.write_wide_csv(f, ["AA", "AC"], str(tmp_path / "m"))
    back = fasta.read_csv(spark, str(tmp_path / "m"), "sequence_id string, genus string, AA double, AC double").first()
    assert tuple(back) == ("s", "g", 0.5, 0.5)
    fasta.write_json(f, str(tmp_path / "x.json"))
    assert json.loads((tmp_path / "x.json").read_text())["genus"] == "g"


def test_merges(spark):
    f = spark.createDataFrame([("a", 1), ("b", 2)], "sequence_id string, x int")
    m = spark.createDataFrame([("a", "train")], "sequence_id string, split string")
    assert taxonomy.inner_merge(f, m).count() == 1
    assert [r[0] for r in taxonomy.unmatched(f, m).collect()] == ["b"]
    with pytest.raises(ValueError, match="no split"):
        taxonomy.merge_manifest(f, m)
    with pytest.raises(ValueError, match="several rows"):
        taxonomy.merge_manifest(f, m.union(m))
    assert clean.without_tool(f)[1] == "skipped"


def test_splits_of_a_file(spark, tmp_path):
    """Files cut into many splits have the rows of files read whole, ordinals included."""
    r = random.Random(3)
    record = lambda i, end: f">{'>' * (i % 7 == 3)}r{i} size={i % 9} a > b{end}" + "".join("".join(r.choices("ACGU", k=r.randint(1, 60))) + end for _ in range(r.randint(0, 6))) + end * (i % 5 == 0)
    whole = lambda n, end="\n": "".join(record(i, end) for i in range(n))
    for name, text in {"Alpha.fa": whole(400), "Beta.clean.fasta": "words before\n" + whole(60), "Gamma.fa": "\n\n" + whole(50, "\r\n"), "Delta.fa": whole(30, "\r"), "Empty.fa": "", "Words.fa": "no record", "One.fa": ">x", "Two.fa": ">\nAC\n>\n"}.items():
        (tmp_path / name).write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        want = sorted(map(tuple, fasta.read_folder(spark, str(tmp_path)).collect()))
        for size in ("97", "1000", "1m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            df = fasta.read_split(spark, str(tmp_path))
            assert df.dtypes == fasta.read_folder(spark, str(tmp_path)).dtypes
            assert sorted(map(tuple, df.collect())) == want
            scanned = spark.read.option("lineSep", "\n>").text(str(tmp_path / "Alpha.fa")).rdd.getNumPartitions()
            assert (scanned > 20) == (size != "1m"), scanned
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        fasta.read_split(spark, str(tmp_path / "none"))


def test_ordinals_of_tables_without_an_order(spark):
    """Over several ranges, with null and equal keys; no task gets all of a genus."""
    from pyspark.sql import Row

    rows = [Row(genus="a" if i % 10 else (None if i % 20 else "b"), key=(i * 7919) % 4001, text="x" * (i % 50)) for i in range(4000)] + [Row(genus="a", key=None, text="n"), Row(genus="c", key=5, text="1"), Row(genus="c", key=5, text="2")]
    df = spark.createDataFrame(rows, "genus string, key long, text string").repartition(3)
    plan = fasta.with_ordinal(df, "key")
    got = sorted((q["genus"] or "", q["seq_idx"], -1 if q["key"] is None else q["key"], q["text"]) for q in plan.collect())
    want, seen = [], {}
    for g, k, t in sorted((r.genus or "", -1 if r.key is None else r.key, r.text) for r in rows):
        seen[g] = seen.get(g, -1) + 1
        want.append((g, seen[g], k, t))
    assert [q[:3] for q in got] == [q[:3] for q in want] and sorted(q[3] for q in got) == sorted(q[3] for q in want)
    lines = [x for x in fasta.with_ordinal(df.filter("genus = 'a'"), "key")._jdf.queryExecution().executedPlan().toString().splitlines() if "Window" in x and "text" in x]
    assert not lines  # texts don't go through a window
