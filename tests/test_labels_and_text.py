import random

import pytest
from pyspark.sql import functions as F

from annotide.functions import text as tx
from annotide.operators import audit, labels, overlap

ROW = "source_row long, example_id string, preceding string, target string, following string, A1_Score string, A2_Score string, A3_Score string"


def rows(spark, data):
    return spark.createDataFrame([(i + 1, f"row-{i + 1}", *r) for i, r in enumerate(data)], ROW)


def test_whitespace_is_python_whitespace(spark):
    texts = [" a \t b ", "\xa0x y　", "\x1cz\x1f", "", None, "ß​"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.strip("t").alias("s"), tx.collapse("t").alias("c"), tx.casefolded("t").alias("f")).collect()
    for t, r in zip(texts, got, strict=True):
        assert r["s"] == (t.strip() if t is not None else None)
        assert r["c"] == " ".join((t or "").split())
        assert r["f"] == " ".join((t or "").split()).casefold()


def test_derived_labels_follow_the_counts_of_random_votes(spark):
    draw = random.Random(11)
    pads = ("", " ", "\t", "\u2003", "\n ")
    votes = [[draw.choice((-1, 0, 1)) for _ in range(3)] for _ in range(200)]
    df = labels.derive(rows(spark, [("", "words", "", *(f"{draw.choice(pads)}{v}{draw.choice(pads)}" for v in three)) for three in votes]))
    derived = {r["source_row"]: r for r in labels.soft_targets(df).collect()}
    assert len(derived) == len(votes)
    for number, three in enumerate(votes, 1):
        ones, zeros, minus = (sum(v == wanted for v in three) for wanted in (1, 0, -1))
        r = derived[number]
        assert (r["hard_label"], r["has_minus1"], r["positive_vote_count"]) == (ones > 1, minus > 0, ones)
        assert [round(3 * r[c]) for c in ("fraction_minus1", "fraction_zero", "fraction_one", "soft_positive", "soft_other")] == [minus, zeros, ones, ones, 3 - ones]
        kinds = (ones > 0) + (zeros > 0) + (minus > 0)
        assert (r["agreement_category"] == "unanimous", r["agreement_category"] == "two-versus-one") == (kinds == 1, kinds == 2)


@pytest.mark.parametrize("vote", ["+1", "\u0661", "1e0", "-0", "--1", "1;0", "one", "\ufeff0", None])
def test_what_only_looks_like_a_vote_is_none(spark, vote):
    df = rows(spark, [("", "w", "", "1", vote, "1"), ("", "w", "", "1", "\u20030\u2003", "1")])
    assert [r["source_row"] for r in labels.vote_violations(df).collect()] == [1]
    assert [r["hard_label"] for r in labels.derive(df).orderBy("source_row").collect()] == [None, 1]


def test_reasons_of_all_combinations_of_blank_texts(spark):
    blank, text = ("", "\u2003\n", None), ("word", "\u200b")
    kinds = [(p, t, f) for p in (*blank, *text) for t in (*blank, *text) for f in (*blank, *text)]
    df = labels.derive(rows(spark, [(*k, "0", "0", "0") for k in kinds]))
    got = [r["exclusion_reason"] for r in df.orderBy("source_row").collect()]
    assert got == ["" if t in text else "target_empty" if p in text or f in text else "all_text_empty" for p, t, f in kinds]
    assert audit.row_accounting(df).agg(F.sum("n_rows")).first()[0] == len(kinds)


def test_placeholders_are_told_from_texts(spark):
    yes = ["NaN", " none", "Null\u2003", "n/a", "NA", "mi\u017fsing"]
    no = ["-", "?", "unknown", "undefined", "n a", "missing.", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in yes + no], "t string").select(F.coalesce(tx.has_placeholder(F.col("t")), F.lit(False))).collect()]
    assert got == [True] * len(yes) + [False] * len(no)
    planted = audit.text_quality(labels.derive(rows(spark, [("none", "a\ufffdb", "c\x07", "0", "0", "0"), ("-", "?", "x\ty", "0", "0", "0")])))
    assert {(r["category"], r["field"]): r["n_rows"] for r in planted.where("n_rows > 0").collect()} == {("placeholder", "preceding"): 1, ("replacement_character", "target"): 1, ("control_character", "following"): 1}


def test_vote_summary_has_every_label_even_of_an_empty_table(spark):
    out = labels.vote_summary(labels.derive(rows(spark, [])))
    assert out.count() == 36 and out.agg(F.sum("n_votes")).first()[0] == 0


def test_conflicting_repeats(spark):
    df = labels.derive(rows(spark, [("", "Same  text", "", "1", "1", "1"), ("", "same TEXT", "", "0", "0", "0"), ("", "other", "", "0", "0", "0")]))
    r = overlap.repeated_targets(df).collect()
    assert len(r) == 1 and (r[0]["n_rows"], r[0]["conflicting"]) == (2, 1)


def test_length_summary_uses_nearest_rank(spark):
    df = labels.derive(rows(spark, [("", " ".join("w" * n), "", "0", "0", "0") for n in range(1, 42)]))
    r = {x["field"]: x for x in audit.length_summary(df, 40).collect()}["target"]
    assert (r["least"], r["median"], r["p95"], r["most"], r["n_above"]) == (1, 21.0, 39, 41, 1)


def test_leak_scan_equals_brute_force(spark):
    sources = [(1, "a source text of more than twenty"), (2, "short"), (3, None), (4, "another one that leaks not at all"), (5, "é" * 25), (5, "é" * 25)]
    outputs = [(10, "x a source text of more than twenty y"), (11, "a source text of more than twentz"), (12, ""), (13, None), (14, "ü" + "é" * 30)]
    got = audit.leak_scan(spark.createDataFrame(outputs, "row long, t string"), "t", spark.createDataFrame(sources, "row long, t string"), "t")
    want = {(o, s) for o, t in outputs for s, u in sources if t and u and len(u) >= 20 and u in t}
    assert {tuple(r) for r in got.collect()} == want


def test_leak_scan_of_all_lengths_with_shared_phrases(spark, monkeypatch):
    draw = random.Random(5)
    words = [f"word{k}" for k in range(400)]
    said = lambda n: "so they said that " + " ".join(draw.choices(words, k=n))
    sources = [(i, said(draw.randrange(1, 40))) for i in range(300)] + [(300, "ab" * 30), (301, "ab" * 15), (302, "x" * 20), (303, "\U0001f600" * 21)]
    outputs = [(i, said(20) + ". " * (i % 2) + (draw.choice(sources)[1] if i % 3 else said(9)) + said(i % 7) * (i % 5)) for i in range(200)]
    outputs += [(200, "ab" * 40), (201, "x" * 19), (202, "x" * 20), (203, "\U0001f600" * 22), (204, "y" + said(3)), (205, sources[7][1])]
    monkeypatch.setattr(audit, "_AT_ONCE", 1000)
    sources += [(i, said(draw.randrange(5))) for i in range(1000, 6000)]  # more than one smallest filter takes
    want = {(o, s) for o, t in outputs for s, u in sources if len(u) >= 20 and u in t}
    a, b = spark.createDataFrame(outputs, "row long, t string"), spark.createDataFrame(sources, "row long, t string")
    for bits in (audit.MOST_BITS, audit.BLOCK_BITS):
        got = [tuple(r) for r in audit.leak_scan(a, "t", b, "t", most_bits=bits).collect()]
        assert len(got) == len(want) > 100 and set(got) == want


def test_leak_scan_does_not_shuffle_the_outputs(spark):
    draw = random.Random(6)
    said = lambda n: "so they said that " + " ".join(f"word{draw.randrange(10**6)}" for _ in range(n))
    outputs = spark.createDataFrame([(i, said(2000)) for i in range(100)], "row long, t string")
    sources = spark.createDataFrame([(i, said(10)) for i in range(100)], "row long, t string")

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    assert audit.leak_scan(outputs, "t", sources, "t").count() == 0
    assert written() - before < 100_000  # of 2 MB of text


def test_denied_partition_is_refused_before_reading():
    with pytest.raises(PermissionError):
        audit.modeling_partition(None, None, None, "test")


def test_missing_ids_are_reported(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "example_id string"), spark.createDataFrame([("x",), ("z",)], "example_id string")
    found, missing = audit.selected_rows(a, b)
    assert [r[0] for r in found.collect()] == ["x"] and [r[0] for r in missing.collect()] == ["z"]
    assert {r["check"]: r["n"] for r in audit.consistency(a, b, "example_id").collect()} == {"left_only": 1, "right_only": 1, "left_repeated": 0, "right_repeated": 0}
