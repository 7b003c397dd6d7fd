import random

import pytest
from pyspark.sql import functions as F

from kmerloom.config import Cleaning
from kmerloom.operators import chimera, clean
from kmerloom.plans import pipeline


def same(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def naive(rows, skew, least):
    """Every place of every sequence against every pair of parents."""
    out = set()
    for i, (g, a, s) in enumerate(rows):
        if s is None:
            continue
        s = s.upper()
        parents = [(j, same(s, t.upper()), same(s[::-1], t.upper()[::-1])) for j, (h, b, t) in enumerate(rows) if h == g and t is not None and b >= skew * a]
        for at in range(least, len(s) - least + 1):
            left = {j for j, p, _ in parents if p >= at}
            right = {j for j, _, p in parents if p >= len(s) - at}
            if any(x != y for x in left for y in right):
                out.add(i)
    return out


def found(spark, rows, skew, least):
    df = spark.createDataFrame([(g, i, a, s) for i, (g, a, s) in enumerate(rows)], "genus string, seq_idx long, size long, sequence string")
    return chimera.find(df, ["genus"], skew, least).collect()


@pytest.mark.parametrize("seed", range(4))
def test_against_every_pair(spark, seed):
    """Mosaics of few letters and near relatives, at every place: proven by multiples, or only between them, or not at all."""
    r = random.Random(seed)
    families = ["".join(r.choices("ACGU", k=r.randint(30, 60))) for _ in range(4)]
    rows = []
    for _ in range(160):
        a, b = r.choice(families), r.choice(families)
        kind = r.random()
        if kind < 0.4:
            at = r.randint(0, len(a))
            s = a[:at] + b[max(0, len(b) - r.randint(0, len(b))):]
        elif kind < 0.8:
            i = r.randrange(len(a))
            s = a[:i] + r.choice("ACGU") + a[i + 1:]
        else:
            s = a[: r.randint(0, 20)] + a[r.randint(20, 30):]
        rows.append((r.choice("gggh"), r.choice([1, 1, 2, 3, 4, 9]), s.lower() if r.random() < 0.1 else s))
    rows += [("g", 1, None), ("g", 50, ""), ("g", 9, families[0]), ("g", 9, families[1])]
    got = found(spark, rows, 2.0, 7)
    want = naive(rows, 2.0, 7)
    assert len(want) > 5
    assert {x["seq_idx"] for x in got} == want and len(got) == len(want)
    for x in got:
        s, left, right = (rows[x[c]][2].upper() for c in ("seq_idx", "left_idx", "right_idx"))
        assert x["left_idx"] != x["right_idx"]
        assert left.startswith(s[: x["break_at"]]) and right.endswith(s[x["break_at"]:])
        assert all(rows[x[c]][1] >= 2 * rows[x["seq_idx"]][1] for c in ("left_idx", "right_idx"))


def test_one_parent_makes_no_chimera(spark):
    """A deletion in the only parent is none; with a second sequence that has one of the parts it is."""
    a = "ACGUUGCAACGGUCAUUGCA" * 2
    cut = a[:15] + a[25:]
    assert found(spark, [("g", 4, a), ("g", 1, cut)], 2.0, 8) == []
    assert [x["seq_idx"] for x in found(spark, [("g", 4, a), ("g", 1, cut), ("g", 2, "G" * 9 + a[25:])], 2.0, 8)] == [1]
    assert found(spark, [("g", 4, a), ("g", 2, cut), ("g", 3, "G" * 9 + a[25:])], 2.0, 8) == []  # not abundant enough


def test_empty_and_wrong_parameters(spark):
    assert found(spark, [], 2.0, 8) == []
    with pytest.raises(ValueError):
        found(spark, [("g", 1, "A")], 1.0, 8)


def test_sizes_of_headers(spark):
    df = spark.createDataFrame([("x;size=12;",), ("x size=3",), ("resize=3",), ("x;size=0",), ("x;size=99999999999999999999",), (None,)], "h string")
    assert [r[0] for r in df.select(chimera.abundance(F.col("h"))).collect()] == [12, 3, 1, 1, 1, 1]


def test_shared_start_makes_few_rows(spark):
    """A start that all sequences have leaves two rows a key, not pairs."""
    r = random.Random(5)
    start = "".join(r.choices("ACGU", k=64))
    rows = [("g", 1 + i % 5, start + "".join(r.choices("ACGU", k=64))) for i in range(300)]
    df = spark.createDataFrame([(g, i, a, s) for i, (g, a, s) in enumerate(rows)], "genus string, seq_idx long, size long, sequence string")
    assert chimera.find(df, ["genus"]).count() == 0
    posts = df.select("genus", F.col("seq_idx").alias("id"), "size", F.lit(32).alias("l"))
    assert [len(x["tops"]) for x in chimera._two(posts, ["genus", "l"]).collect()] == [2]
    assert "WindowGroupLimit" in chimera._two(posts, ["genus", "l"])._jdf.queryExecution().executedPlan().toString()


def test_step_of_the_cleaning(spark):
    """Copies make a parent abundant; planted chimeras go, parents and strangers stay, the summary counts."""
    r = random.Random(7)
    a, b, other = ("".join(r.choices("ACGU", k=90)) for _ in range(3))
    rows = [("g", "f1", s) for s in (a, a, b, b.lower(), a[:40] + b[40:], other)] + [("g", "f2", a[:40] + b[40:])]
    df = spark.createDataFrame([(g, f, i, "x", s) for i, (g, f, s) in enumerate(rows)], "genus string, file string, seq_idx long, header string, sequence string")
    stay, summary = clean.clean(df, Cleaning(min_len=10, max_len=200, chimeras="denovo"))
    assert sorted(x["seq_idx"] for x in stay.collect()) == [0, 2, 5, 6] and stay.columns == df.columns
    assert sorted((x["file"], x["dropped_chimeras"], x["final"], x["chimera_status"]) for x in summary.collect()) == [("f1", 1, 3, "ran"), ("f2", 0, 1, "ran")]
    with pytest.raises(ValueError):
        clean.clean(df, Cleaning(chimeras="some"))


def test_entry_point(spark, tmp_path):
    """The cleaning of a folder with the step that its parameters name."""
    r = random.Random(9)
    a, b = ("".join(r.choices("ACGU", k=90)) for _ in range(2))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Genus.fa").write_text(f">a;size=4\n{a}\n>b;size=3\n{b}\n>m;size=1\n{a[:50]}\n{b[50:]}\n")
    stay, summary = pipeline.clean_folder(spark, str(tmp_path / "in"), c=Cleaning(min_len=10, max_len=200, chimeras="denovo"))
    assert sorted(x["header"] for x in stay.collect()) == ["a;size=4", "b;size=3"]
    assert [(x["dropped_chimeras"], x["final"]) for x in summary.collect()] == [(1, 2)]


def test_tasks_stay_small(spark):
    """Digests of shared starts compress so well that a task of Spark's advised size would take gigabytes; the setting comes back."""
    from kmerloom.sources import stored

    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    with stored.small_tasks(spark):
        assert spark.conf.get(setting) == stored.ADVISED == "8m"
    assert spark.conf.get(setting) == before
    r = random.Random(5)
    rows = [("g", i, 1, "".join(r.choices("ACGU", k=70))) for i in range(30)]
    df = spark.createDataFrame(rows, "genus string, seq_idx long, size long, sequence string")
    assert "stored_in" in chimera.find(df, ["genus"]).__dict__  # all of it runs with that setting
    assert spark.conf.get(setting) == before


def plans_of(monkeypatch, module):
    """What Spark plans for each table that a module stores, before it has measured anything."""
    plans, store = [], module.stored

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(module, "stored", seen)
    return plans


def test_files_sizes_send_nothing_to_the_tasks(spark, monkeypatch):
    """Stored tables are a hundredth of what is made from them: a join that went by their size filled the driver. Settings come back."""
    from kmerloom.sources import stored

    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(k, None) for k in settings]
    r = random.Random(11)
    a, b = ("".join(r.choices("ACGU", k=90)) for _ in range(2))
    plans = plans_of(monkeypatch, chimera)
    assert [x["seq_idx"] for x in found(spark, [("g", 4, a), ("g", 4, b), ("g", 1, a[:41] + b[41:]), ("g", 1, a[10:70])], 2.0, 32)] == [2]
    assert len(plans) == 2 and not [p for p in plans if "BroadcastExchange" in p]
    with stored.measured_joins(spark), stored.measured_joins(spark):
        assert spark.conf.get(settings[0]) == "-1" and spark.conf.get(settings[1]) == before[0]
    assert [spark.conf.get(k, None) for k in settings] == before


def test_the_cleaning_sends_nothing_by_files_sizes(spark, monkeypatch):
    """The same of the step before, and of what its results are joined with."""
    from kmerloom.operators import containment

    r = random.Random(12)
    a, b = ("".join(r.choices("ACGU", k=90)) for _ in range(2))
    df = spark.createDataFrame([("g", i, s) for i, s in enumerate((a, b, a[10:70]))], "genus string, seq_idx long, sequence string")
    plans = plans_of(monkeypatch, containment)
    assert [x["seq_idx"] for x in containment.contained(df, ["genus"]).collect()] == [2]
    assert len(plans) > 8 and not [p for p in plans if "BroadcastExchange" in p]
    for joined in (clean.drop_nested(df), clean.without_chimeras()(df.withColumn("size", F.lit(1)))[0]):
        assert "BroadcastExchange" not in joined._jdf.queryExecution().executedPlan().toString()
