import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.config import Cleaning
from kmerloom.operators import clean

SMALL = Cleaning(min_len=4, max_len=40, max_n_frac=0.1)


def records(spark, rows):
    return spark.createDataFrame([(g, i, h, s) for i, (g, h, s) in enumerate(rows)], "genus string, seq_idx long, header string, sequence string")


def test_reasons(spark):
    cases = [
        ("x Uncultured y", "ACGU", "ambiguous_label"), ("X subsp. y", "ACGU", "ambiguous_label"), ("bad sp. label", "A", "ambiguous_label"),
        ("ok", "ACG", "length_out_of_range"), ("ok", "ACGU", "pass"), ("ok", "A" * 40, "pass"), ("ok", "A" * 41, "length_out_of_range"),
        ("ok", "ACGUACGUAN", "pass"), ("ok", "ACGUACGUNN", "too_many_ambiguous_bases"), ("ok", "ACGT", "too_many_ambiguous_bases"), ("ok", "acgu", "pass"),
    ]
    got = {r["seq_idx"]: r["drop_reason"] for r in clean.with_reason(records(spark, [("g", h, s) for h, s, _ in cases]), SMALL).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def test_options(spark):
    r = records(spark, [("g", "X subsp. y", "ACGU"), ("g", "a sp. b", "ACGU"), ("g", "ok", "ACGT"), ("g", "ok", "")])
    word = [x["drop_reason"] for x in clean.with_reason(r, Cleaning(min_len=0, max_len=40, word_boundary=True, normalize_t=True)).orderBy("seq_idx").collect()]
    assert word == ["pass", "ambiguous_label", "pass", "empty_sequence"]


def test_exact_dedup(spark):
    r = records(spark, [("g", "a", "ACGU"), ("g", "b", "acgu"), ("h", "c", "ACGU"), ("g", "d", "CCGG"), ("g", "e", "AACC"), ("g", "f", "GGUU")])
    assert sorted(x["seq_idx"] for x in clean.exact_dedup(r).collect()) == [0, 2, 3, 4, 5]
    assert sorted(x["seq_idx"] for x in clean.exact_dedup(r, "both").collect()) == [0, 2, 3, 4]


def naive(rows, both=True):
    rc = lambda s: s[::-1].translate(str.maketrans("ACGU", "UGCA"))
    kept = []
    for i, (g, s) in sorted(enumerate(rows), key=lambda x: (-len(x[1][1]), x[0])):
        if not any(g == h and (s in t or both and rc(s) in t) for _, (h, t) in kept):
            kept.append((i, (g, s)))
    return sorted(i for i, _ in kept)


def test_nested_against_naive(spark):
    r = random.Random(3)
    whole = ["".join(r.choices("ACGU", k=k)) for k in (300, 180, 90, 60)]
    rc = lambda s: s[::-1].translate(str.maketrans("ACGU", "UGCA"))
    rows = []
    for _ in range(150):
        w = r.choice(whole)
        n = r.choice([0, 1, 3, 7, 8, 20, 49, 50, 51, 70, 120])
        a = r.randint(0, max(0, len(w) - n))
        s = w[a : a + n] if r.random() < 0.8 else "".join(r.choices("ACGU", k=n))
        rows.append((r.choice("gh"), rc(s) if r.random() < 0.4 else s))
    rows += [("g", w) for w in whole]
    df = records(spark, [(g, "", s) for g, s in rows])
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df).collect()) == naive(rows)
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df, "forward").collect()) == naive(rows, False)
    again = clean.drop_nested(clean.drop_nested(df))
    assert again.count() == len(naive(rows))


def test_summary_keeps_lost_genera(spark):
    rows = [("g", "ok", "ACGUACGU"), ("g", "ok", "acguacgu"), ("g", "ok", "CGUA"), ("g", "unknown", "ACGU"), ("lost", "ok", "A")]
    stay, summary = clean.clean(records(spark, rows), SMALL)
    s = {r["genus"]: r for r in summary.collect()}
    assert [r["seq_idx"] for r in stay.collect()] == [0]
    g = s["g"]
    assert (g["input"], g["dropped_ambiguous_label"], g["passed_quality"], g["dropped_duplicates"], g["dropped_nested"], g["final"]) == (4, 1, 3, 1, 1, 1)
    assert (s["lost"]["final"], s["lost"]["dropped_length_out_of_range"]) == (0, 1)
    assert summary.columns[-1] == "dropped_empty_sequence"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ACGU", min_size=0, max_size=60), min_size=1, max_size=12))
def test_nested_property(spark, sequences):
    rows = [("g", s) for s in sequences]
    assert sorted(x["seq_idx"] for x in clean.drop_nested(records(spark, [(g, "", s) for g, s in rows])).collect()) == naive(rows)


def test_first_wins(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), (None, 2), (None, 5), ("b", 4)], "k string, i int")
    assert sorted(r["i"] for r in clean.first_wins(df, ["k"], ["i"]).collect()) == [3, 5]


def test_a_genus_in_two_files(spark, tmp_path):
    """Ordinals start again in each file, and files are cleaned one by one."""
    from kmerloom.plans import pipeline
    from kmerloom.sources import fasta

    whole = "ACGUUGCAACGGUUACGUCA" * 4
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Alpha.fa").write_text(f">a whole\t \n{whole}\n>b inside\n{whole[5:60]}\n")
    (tmp_path / "in" / "Alpha.fasta").write_text(">c\nGGGGCCCCAAAAUUUU\n>d\nACACACACACACGGGG\n>e\nUUUUGGGGAACCAACC\n>f\nUUUUGGGGAACCAACC\n")
    c = Cleaning(min_len=4, max_len=400)
    records, summary = pipeline.clean_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), c, intermediates=True)
    assert sorted(r["header"] for r in records.collect()) == ["a whole", "c", "d", "e"]
    assert sorted((r["file"], r["input"], r["dropped_duplicates"], r["dropped_nested"], r["final"]) for r in summary.collect()) == [("Alpha.fa", 2, 0, 1, 1), ("Alpha.fasta", 4, 1, 0, 3)]
    again = fasta.read_folder(spark, str(tmp_path / "out")).collect()
    assert sorted((r["genus"], r["header"], r["sequence"]) for r in again) == sorted((r["genus"], r["header"], r["sequence"]) for r in records.collect())
    stages = {p.name: len([x for f in p.rglob("part-*") if not f.name.endswith(".crc") for x in f.read_text().split("\n") if x.startswith(">")]) for p in (tmp_path / "out" / "_intermediate").iterdir() if p.is_dir()}
    assert stages == {"1_label_quality": 6, "2_dedup": 5, "3_nonnested": 4, "4_final_clean": 4}


def test_shared_starts_give_few_candidates(spark):
    """Sequences of a genus that all begin alike are told apart by their rarest seeds."""
    r = random.Random(8)
    start = "".join(r.choices("ACGU", k=120))
    rows = [("g", start + "".join(r.choices("ACGU", k=200))) for _ in range(150)]
    rows += [("g", s[20:280]) for _, s in rows[:20]] + [("g", start)]
    df = records(spark, [(g, "", s) for g, s in rows])
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df).collect()) == naive(rows)


def test_a_conserved_region_gives_few_candidates(spark, monkeypatch):
    """Fragments of a region that all sequences of a genus share, near copies, and parts that two of them make up."""
    from kmerloom.operators import containment

    r = random.Random(4)
    part = lambda n: "".join(r.choices("ACGU", k=n))
    shared = part(400)
    whole = [part(150) + shared + part(150) for _ in range(120)]
    fragments = [shared[i : i + 200 + i % 37] for i in range(0, 120)]
    strains = [whole[0][:-1] + c for c in "ACGU"] + [whole[1][:300] + c + whole[1][301:] for c in "ACGU"]
    mosaics = [whole[k][100:350] + whole[k + 1][350:600] for k in range(20)] + [whole[k][:149] + part(1) + shared[:300] for k in range(20)]
    rows = [("g", s) for s in [*whole, *fragments, *strains, *mosaics]] + [("h", fragments[0]), ("h", shared)]
    counted, pairs = [], containment._candidates
    monkeypatch.setattr(containment, "_candidates", lambda *a: counted.append(pairs(*a).count()) or pairs(*a))
    df = records(spark, [(g, "", s) for g, s in rows])
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df).collect()) == naive(rows)
    assert 0 < sum(counted) < 4 * len(rows), counted


def test_chimera_plug_in(spark):
    """A filter that takes some records away is counted per genus."""
    df = records(spark, [("g", "keep", "ACGUACGUAA"), ("g", "chimera", "GGGGCCCCAA"), ("h", "chimera", "UUUUAAAACC")])
    stay, summary = clean.clean(df, SMALL, lambda r: (r.filter("header = 'keep'"), "ran"))
    assert [r["seq_idx"] for r in stay.collect()] == [0]
    assert sorted((r["genus"], r["dropped_chimeras"], r["final"], r["chimera_status"]) for r in summary.collect()) == [("g", 1, 1, "ran"), ("h", 1, 0, "ran")]


def test_nested_of_all_lengths(spark):
    """Parts about the lengths at which levels begin, of texts that repeat themselves, in copies, on both strands; null and other letters."""
    r = random.Random(12)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGU", "UGCA"))
    whole = ["".join(r.choices("ACGU", k=1100)), "ACG" * 200, "A" * 300, "".join(r.choices("ACGU", k=40)) * 9]
    rows = [("g", w) for w in whole]
    for w in whole:
        for n in (1, 2, 15, 16, 31, 32, 33, 63, 64, 65, 127, 128, 129, 255, 256, 257, 300):
            a = r.randint(0, len(w) - n)
            rows.append(("gh"[n % 2], r.choice([w[a : a + n], rc(w[a : a + n]), w[a : a + n // 2] + "N" + w[a + n // 2 + 1 : a + n]])))
    rows += r.sample(rows, 20)
    df = records(spark, [(g, "", s) for g, s in rows])
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df).collect()) == naive(rows)
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df, "forward").collect()) == naive(rows, False)


def test_containment_stores_few_rows_a_sequence(spark, monkeypatch):
    """What is stored and shuffled is in proportion to sequences, not to letters."""
    from kmerloom.operators import containment

    r = random.Random(13)
    rows = [("g", "".join(r.choices("ACGU", k=3000))) for _ in range(60)]
    rows += [("g", s[700:1500]) for _, s in rows[:20]]
    told, store = {}, containment.stored

    def counted(df, name):
        out = store(df, name)
        told[name] = told.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(containment, "stored", counted)
    df = records(spark, [(g, "", s) for g, s in rows])
    assert sorted(x["seq_idx"] for x in clean.drop_nested(df).collect()) == naive(rows)
    assert sum(told.values()) < 30 * len(rows), told


def test_stages_keep_copies_apart(spark):
    """Copies are duplicates even where something contains them; what only a dropped reverse complement contains stays with strand forward."""
    a = "ACGUUGCAACGGUUACGUCA"
    rc = a[::-1].translate(str.maketrans("ACGU", "UGCA"))
    rows = [("g", "", s) for s in (rc, a, a, a[3:15], a[3:15].lower())]
    for c, want in ((("forward", "forward"), "pass pass duplicate nested duplicate"), (("forward", "both"), "pass nested duplicate nested duplicate"), (("both", "forward"), "pass duplicate duplicate pass duplicate"), (("both", "both"), "pass duplicate duplicate nested duplicate")):
        got = clean.stages(records(spark, rows), Cleaning(min_len=4, max_len=40, dedup=c[0], strand=c[1])).orderBy("seq_idx").collect()
        assert [x["drop_reason"] for x in got] == want.split(), c


def test_levels_share_their_hashes(monkeypatch):
    """Minimizers of all levels are those of each span by itself, and a level's windows are made from those of the level before."""
    import numpy as np
    import pyarrow as pa

    from kmerloom.operators import containment

    r = random.Random(15)
    texts = ["".join(r.choices("ACGU", k=n)) for n in (5, 700, 0, 64, 63, 300, 1100)] + ["ACG" * 90, "A" * 200]
    b = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)), pa.int64())], ["s", "scope"])
    made, longer = [], containment._longer
    monkeypatch.setattr(containment, "_longer", lambda h, have, size: made.append(size // have) or longer(h, have, size))
    levels = list(range(11))
    got = {level: list(zip(row.tolist(), pos.tolist(), strict=True)) for level, row, pos, _ in containment._postings(b, "s", levels)}
    assert np.prod(made) == 256  # eight times twice as long for all levels, not 46 times
    for level in levels:
        span = 1 << level
        size, want = min(span, max(containment.SEED, span >> 2)), set()
        for i, s in enumerate(texts):
            h = longer(containment._LETTERS[np.frombuffer(s.encode(), np.uint8)], 1, size) | np.uint64(1)
            for at in range(len(s) - span + 1):
                own = h[at : at + span - size + 1]
                want |= {(i, at + int(k)) for k in np.flatnonzero(own == own.min())}
        assert got.get(level, []) == sorted(want)


def test_complements_are_sparks(spark):
    """Letters of any size, and those that have no partner; Spark makes none of them for containment."""
    from kmerloom.functions import sequences
    from kmerloom.operators import containment

    texts = ["ACGUN", "", "ÄAC😀GT", "RYKMBVDHSW-.", "ACGU" * 99]
    df = spark.createDataFrame([(s,) for s in texts], "s string")
    assert containment._complements(texts) == [r[0] for r in df.select(sequences.reverse_complement(F.col("s"))).collect()]
    rows = [("g", s) for s in ("AAÄ😀" + "ACGGU" * 20 + "AA", "ACCGU" * 20 + "😀Ä", "ACCGU" * 20 + "Ä😀")]
    assert sorted(x["seq_idx"] for x in clean.drop_nested(records(spark, [(g, "", s) for g, s in rows])).collect()) == [0, 2]
