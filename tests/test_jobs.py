import json
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import intake, release
from jobs.records import Columns, Settings, settings
from kmerloom.config import Cleaning, Kmers, Splitting

ROOT = Path(__file__).resolve().parents[1]
PLAIN = Columns("id", "genus", "accession", "header", "sequence")
SETTINGS = Settings(columns=PLAIN, cleaning=Cleaning(min_len=10, max_len=400, terms=("bad",)), kmers=Kmers(2), splitting=Splitting())
SCHEMA = "id long, genus string, accession string, header string, sequence string, extra string"


def write(spark, rows, path):
    spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def counts(sequences):
    out = Counter(s[i : i + 2] for s in sequences for i in range(len(s) - 1))
    return {k: n for k, n in out.items() if set(k) <= set("ACGU")}


def decisions(spark, target):
    return sorted(map(tuple, spark.read.schema(intake.DECISIONS).parquet(f"{target}/decisions").collect()), key=repr)


def profile(spark, target):
    return {(r["genus"], r["kmer"]): (r["n"], round(r["share"], 9)) for r in spark.read.schema(intake.PROFILE).parquet(f"{target}/profile").collect()}


def test_intake_takes_only_what_is_new(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    a, b, c = "ACGUACGUACGUA", "GGCCAAUUGGCCAAUU", "UUUUUUUUUUUUU"
    write(spark, [(1, "g", "x", "ok", a), (2, "g", "x", "ok", a.lower()), (3, "h", "x", "ok", a), (4, "g", "y", "bad", b), (5, "g", "y", "ok", "ACGU"), (6, None, "y", None, b), (7, "g", "y", "ok", None)], source)
    intake.run(spark, source, target, SETTINGS)
    first = {r[0]: r[5] for r in decisions(spark, target)}
    assert first == {1: "admitted", 2: "duplicate", 3: "admitted", 4: "ambiguous_label", 5: "length_out_of_range", 6: "admitted", 7: "length_out_of_range"}
    before = decisions(spark, target)
    intake.run(spark, source, target, SETTINGS)  # nothing is new
    assert decisions(spark, target) == before

    write(spark, [(8, "g", "x", "ok", a), (9, "g", "x", "ok", c), (10, "h", "x", "ok", c), (None, "h", "x", "ok", b), (0, None, "x", "ok", b)], source)
    intake.run(spark, source, target, SETTINGS)
    now = decisions(spark, target)
    assert [r for r in now if r[4] == 0] == before
    assert {r[0]: r[5] for r in now if r[4] == 1} == {8: "duplicate", 9: "admitted", 10: "admitted", None: "no_id", 0: "duplicate"}
    want = {}
    for genus, own in (("g", [a, c]), ("h", [a, c]), (None, [b])):
        n = counts(own)
        want |= {(genus, k): (v, round(v / sum(n.values()), 9)) for k, v in n.items()}
    assert profile(spark, target) == want
    # the last batch runs again, as after a failure between its writes and its mark
    intake.take(spark.read.parquet(source).filter("id is null or id in (0, 8, 9, 10)"), 1, target, SETTINGS)
    intake.publish(spark, target)
    assert decisions(spark, target) == now and profile(spark, target) == want
    assert intake.output(spark, target).count() == len(now) + len(want)


def test_intake_in_several_batches(spark, tmp_path):
    """Files one by one or all at once: the same sequences are admitted, the same profile comes out."""
    r = random.Random(2)
    pool = ["".join(r.choices("ACGU", k=20)) for _ in range(15)]
    files = [[(100 * k + i, r.choice("gh"), "x", r.choice(["ok", "bad"]), r.choice(pool)) for i in range(12)] for k in range(4)]
    out = []
    for at_once in (1, 0):
        source, target = str(tmp_path / f"in{at_once}"), str(tmp_path / f"out{at_once}")
        for f in files:
            write(spark, f, source)
        s = Settings(files_at_once=at_once, schema=SCHEMA, columns=PLAIN, cleaning=SETTINGS.cleaning, kmers=Kmers(2))
        intake.run(spark, source, target, s)
        got = decisions(spark, target)
        assert len({x[4] for x in got}) == (4 if at_once else 1)
        out.append((Counter(x[5] for x in got), profile(spark, target)))
    assert out[0] == out[1] and sum(out[0][0].values()) == 48


def test_intake_of_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    s = Settings(schema=SCHEMA, columns=PLAIN)
    for _ in range(2):
        intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), s)
    assert intake.output(spark, str(tmp_path / "out")).count() == 0
    write(spark, [(1, "g", "x", "bad", "ACGU")], str(tmp_path / "in"))
    intake.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), s)
    assert [r["decision"] for r in intake.output(spark, str(tmp_path / "out")).collect()] == ["length_out_of_range"]


def rows_of_release():
    r = random.Random(6)
    whole = ["".join(r.choices("ACGU", k=120)) for _ in range(40)]
    rows = [(i, "gh"[i % 2], f"acc{i % 12}", "ok", s) for i, s in enumerate(whole)]
    rows += [(100, "g", "acc1", "ok", whole[0].lower()), (101, "g", "acc2", "ok", whole[2][5:90]), (102, "h", "acc2", "ok", whole[2][5:90]), (103, "g", "acc3", "bad", whole[1]), (104, "g", "acc3", None, None)]
    return rows


def read_release(spark, target):
    return sorted(map(str, release.output(spark, target).collect()))


def test_release_twice(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    rows = rows_of_release()
    write(spark, rows, source)
    release.build(spark, source, target, SETTINGS)
    out = {r["seq_idx"]: r for r in release.output(spark, target).collect()}
    assert {i: out[i]["drop_reason"] for i in range(100, 105)} == {100: "duplicate", 101: "nested", 102: "pass", 103: "ambiguous_label", 104: "length_out_of_range"}
    assert len(out) == len(rows)
    by_id = {r[0]: r for r in rows}
    vocabulary = [a + b for a in "ACGU" for b in "ACGU"]
    splits = {}
    for i, r in out.items():
        if r["drop_reason"] == "pass":
            assert r["kmers"] == [counts([by_id[i][4]])[k] if k in counts([by_id[i][4]]) else 0 for k in vocabulary]
            splits.setdefault(r["accession"], set()).add(r["split"])
        else:
            assert r["split"] is None and r["kmers"] is None
    assert all(len(s) == 1 for s in splits.values()) and len(splits) == 12
    assert {p.name for p in (tmp_path / "out" / "training").iterdir() if p.is_dir()} == {"split=train", "split=val", "split=test"}
    classes = [json.loads(x) for f in (tmp_path / "out" / "classes").glob("part-*") for x in f.read_text().splitlines()]
    assert sum(c["records"] for c in classes) == sum(r["drop_reason"] == "pass" for r in out.values())
    before = read_release(spark, target)
    release.build(spark, source, target, SETTINGS)
    assert read_release(spark, target) == before
    # a run over less leaves nothing behind of what was there
    write(spark, [r for r in rows if r[1] == "g"], str(tmp_path / "less"))
    release.build(spark, str(tmp_path / "less"), target, SETTINGS)
    assert {r["genus"] for r in release.output(spark, target).collect()} == {"g"}
    assert not list((tmp_path / "out" / "training").rglob("genus=h"))


def test_release_refuses_ids_that_are_not_unique(spark, tmp_path):
    write(spark, [(1, "g", "x", "ok", "ACGU" * 5), (1, "g", "x", "ok", "ACGG" * 5)], str(tmp_path / "twice"))
    write(spark, [(None, "g", "x", "ok", "ACGU" * 5)], str(tmp_path / "none"))
    with pytest.raises(ValueError, match="several records"):
        release.build(spark, str(tmp_path / "twice"), str(tmp_path / "out"), SETTINGS)
    with pytest.raises(ValueError, match="no id"):
        release.build(spark, str(tmp_path / "none"), str(tmp_path / "out"), SETTINGS)


def test_settings(tmp_path):
    for name in ("release", "intake"):
        assert settings(str(ROOT / "jobs" / f"{name}.toml")) == Settings()
    f = tmp_path / "c.toml"
    f.write_text('format = "csv"\n[options]\nheader = "true"\n[cleaning]\nterms = ["a", "b"]\n')
    s = settings(str(f))
    assert (s.format, s.options, s.cleaning.terms, s.cleaning.min_len) == ("csv", {"header": "true"}, ("a", "b"), 200)
    for wrong in ("[cleaning]\nlength = 3\n", "speed = 1\n"):
        f.write_text(wrong)
        with pytest.raises(ValueError, match="unknown"):
            settings(str(f))


def test_command_line(spark, tmp_path):
    """Its own process and session; CSV in, settings from a file."""
    rows = rows_of_release()
    spark.createDataFrame(rows, SCHEMA.rpartition(",")[0]).coalesce(1).write.csv(str(tmp_path / "in"), header=True)
    (tmp_path / "c.toml").write_text('format = "csv"\n[options]\nheader = "true"\n[columns]\nid = "id"\ngenus = "genus"\naccession = "accession"\nheader = "header"\nsequence = "sequence"\n[cleaning]\nmin_len = 10\nmax_len = 400\nterms = ["bad"]\n[kmers]\nk = 2\n')
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "spark-defaults.conf").write_text(f"spark.master local[2]\nspark.ui.enabled false\nspark.sql.shuffle.partitions 2\nspark.checkpoint.dir {tmp_path}/shared\n")
    done = subprocess.run([sys.executable, "-m", "jobs.intake", str(tmp_path / "in"), str(tmp_path / "out"), "--config", str(tmp_path / "c.toml")], cwd=ROOT, env={**__import__("os").environ, "SPARK_CONF_DIR": str(tmp_path / "conf")}, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-3000:]
    assert f"batch 0: read {len(rows)} records" in done.stderr and "batch 0: wrote 1 records ambiguous_label" in done.stderr
    assert intake.output(spark, str(tmp_path / "out")).filter("what = 'record'").count() == len(rows)
