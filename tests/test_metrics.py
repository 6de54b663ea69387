import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.operators import bootstrap as bs
from annotide.operators import metrics as mt
from annotide.operators import selective as sl

SF = Path("/root/testdata/sf0.001")
FACTS = "experiment string, example_id long, group_id long, y int, pred int, p double, soft double"


def facts(spark, rows, experiment="E"):
    return spark.createDataFrame([(experiment, i, i % 3, y, pred, p, s) for i, (y, pred, p, s) in enumerate(rows)], FACTS)


@pytest.fixture()
def four(spark):
    return facts(spark, [(0, 0, 0.1, 0.0), (0, 1, 0.6, 0.33), (1, 0, 0.4, 0.67), (1, 1, 0.9, 1.0)])


def test_known_values(four):
    c = mt.confusion(four).first()
    assert (c["tn"], c["fp"], c["fn"], c["tp"]) == (1, 1, 1, 1)
    assert mt.roc_auc(four).first()["roc_auc"] == 0.75
    assert mt.average_precision(four).first()["average_precision"] == pytest.approx(5 / 6)
    assert mt.probability_metrics(four).first()["brier"] == pytest.approx(0.185)


def test_one_class_gives_nulls(spark):
    one = facts(spark, [(0, 0, 0.2, 0.0), (0, 0, 0.3, 0.0)])
    assert mt.roc_auc(one).first()["roc_auc"] is None
    assert mt.average_precision(one).first()["average_precision"] is None
    m = mt.class_metrics(mt.confusion(one), nullable=True).first()
    assert m["recall_1"] is None and m["macro_f1"] is None
    assert mt.class_metrics(mt.confusion(one)).first()["macro_f1"] == 0.5


def test_ranking_equals_brute_force_with_ties(spark):
    r = random.Random(3)
    rows = [(int(r.random() < 0.4), 0, r.randrange(6) / 5, 0.0) for _ in range(80)]
    df = facts(spark, rows)
    pos, neg = [p for y, _, p, _ in rows if y], [p for y, _, p, _ in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert mt.roc_auc(df).first()["roc_auc"] == pytest.approx(auc)
    ap = 0.0
    for t in sorted({p for *_, p, _ in rows}, reverse=True):
        seen = [(y, p) for y, _, p, _ in rows if p >= t]
        ap += sum(y for y, p in seen if p == t) / len(pos) * sum(y for y, _ in seen) / len(seen)
    assert mt.average_precision(df).first()["average_precision"] == pytest.approx(ap)


def test_bins_are_closed_at_the_end_and_empty_ones_null(spark):
    out = {r["bin"]: r for r in mt.reliability(facts(spark, [(1, 1, 1.0, 1.0), (0, 0, 0.0, 0.0), (0, 1, math.nextafter(0.9, 0), 0.0)])).collect()}
    assert len(out) == 10 and out[0]["n"] == out[9]["n"] == out[8]["n"] == 1
    assert out[5]["n"] == 0 and out[5]["mean_p"] is None


def test_spearman(spark):
    assert mt.spearman(facts(spark, [(0, 0, x / 10, x * x / 100) for x in range(8)])).first()["spearman"] == pytest.approx(1)
    assert mt.spearman(facts(spark, [(0, 0, 0.5, x / 10) for x in range(4)])).first()["spearman"] is None


def test_agreement_and_comparison(spark):
    both = facts(spark, [(1, 1, 0.8, 1.0), (0, 0, 0.1, 0.0)], "A").union(facts(spark, [(1, 0, 0.4, 1.0), (0, 0, 0.1, 0.0)], "B"))
    assert mt.model_agreement(both).first()["agreement"] == 0.5
    d = {r["metric"]: r["difference"] for r in mt.compared(mt.class_metrics(mt.confusion(both)).select("experiment", "recall_1", "accuracy"), [("A", "B")]).collect()}
    assert d == {"recall_1": 1.0, "accuracy": 0.5}
    assert mt.verdicts(mt.compared(mt.class_metrics(mt.confusion(both)).select("experiment", "recall_1"), [("B", "A")])).first()["verdict"] == "unfavourable"


def test_nulls_take_no_part(spark):
    df = spark.createDataFrame([("E", 1, 1, 1, 1, None, None), ("E", 2, None, None, None, 0.5, None), ("E", 3, 1, 0, 0, 0.2, 0.0), ("E", 4, 1, 1, 1, 0.7, 1.0)], FACTS)
    assert mt.probability_metrics(df).first()["n"] == 2
    assert mt.roc_auc(df).first()["roc_auc"] == 1.0


def test_risk_coverage(spark):
    df = facts(spark, [(1, 1, 0.9, 1.0), (0, 0, 0.2, 0.0), (1, 1, 0.55, 1.0), (0, 0, 0.05, 0.0)])
    at = {round(r["threshold"], 2): r for r in sl.risk_coverage(df).collect()}
    assert at[0.6]["accepted"] == 3 and at[0.6]["coverage_1"] == 0.5 and at[0.5]["accepted"] == 4
    half = {round(r["threshold"], 2): r for r in sl.risk_coverage(facts(spark, [(1, 1, 0.5, 1.0)])).collect()}
    assert half[0.99]["risk"] is None and half[0.99]["accepted"] == 0


def test_wilson_and_policies(spark):
    low, high = sl.wilson(F.col("k"), F.col("n"))
    a, b = spark.createDataFrame([(0, 0), (5, 10)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert (a["l"], a["h"]) == (None, None) and b["l"] == pytest.approx(0.2366, abs=1e-4) and b["h"] == pytest.approx(0.7634, abs=1e-4)
    df = facts(spark, [(i % 2, i % 2, 0.5 + 0.49 * (i % 2) if i % 2 else 0.05 * (i % 9), 0.0) for i in range(60)])
    assert {r["policy"] for r in sl.policy_candidates(sl.risk_coverage(df)).collect()} >= {"fixed_0.70", "fixed_0.80", "fixed_0.90"}


def test_temperature_search_finds_the_minimum(spark):
    r = random.Random(1)
    rows = []
    for i in range(300):
        z = r.gauss(0, 1)
        rows.append(("E", int(r.random() < 1 / (1 + math.exp(-z))), 0.0, 3 * z))
    df = spark.createDataFrame(rows, "experiment string, y int, l0 double, l1 double")
    best = sl.fit_temperature(df).first()
    grid = sl.temperature_grid(df, tuple(2 + k / 10 for k in range(25))).orderBy("nll").first()
    assert best["nll"] <= grid["nll"] + 1e-9 and best["temperature"] == pytest.approx(grid["temperature"], abs=0.15)
    flat = spark.createDataFrame([("E", 1, 0.0, 0.0)], "experiment string, y int, l0 double, l1 double")
    assert sl.temperature_grid(flat, (1.0,)).first()["nll"] == pytest.approx(math.log(2))
    kept = sl.calibrated(df, sl.fit_temperature(df)).where("not decision_kept").count()
    assert kept == 0


def test_bootstrap_is_paired_and_repeatable(spark):
    df = facts(spark, [(i % 2, int(i % 3 == 0), (i % 7) / 8 + 0.05, 0.5) for i in range(30)])
    stats = bs.group_statistics(df)
    a = sorted(map(tuple, bs.twister_sample(stats, 20, 5).collect()))
    assert a == sorted(map(tuple, bs.twister_sample(stats, 20, 5).collect()))
    assert all(sum(t for k, _, t in a if k == i) == 3 for i in range(20))
    assert bs.stream_hash(3, 20, 5) == bs.stream_hash(3, 20, 5) != bs.stream_hash(3, 20, 6)
    values = bs.replicate_metrics(stats, bs.twister_sample(stats, 20, 5))
    assert values.count() == 20
    # all groups drawn once give the metrics of the whole
    once = spark.createDataFrame([(0, g, 1) for g in range(3)], "replicate long, group_id long, times long")
    assert bs.replicate_metrics(stats, once).first()["macro_f1"] == pytest.approx(mt.class_metrics(mt.confusion(df)).first()["macro_f1"])


@pytest.mark.parametrize("n", [1, 7, 64, 3000])
def test_draws_in_tasks_are_those_of_one_stream(spark, monkeypatch, n):
    monkeypatch.setattr(bs, "WORDS", 1000)
    rows = [("E", g, 1, 0, 0, 1, 2, 0.5, 0.25) for g in range(n)]
    stats = spark.createDataFrame(rows, "experiment string, group_id long, tn long, fp long, fn long, tp long, n long, nll double, brier double")
    want = [(k, g, t) for k, indices in enumerate(bs.drawn(n, 150, 9)) for g, t in sorted(Counter(indices).items())]
    assert sorted(map(tuple, bs.twister_sample(stats, 150, 9).collect())) == want


def test_more_groups_than_one_driver_list(spark):
    n = 20_500
    stats = spark.range(n).selectExpr("explode(array('A', 'B')) as experiment", "id as group_id", "id % 2 as tn", "id % 3 as fp", "id % 5 as fn", "id % 7 as tp", "id % 2 + id % 3 + id % 5 + id % 7 as n", "id / 10.0D as nll", "id % 4 / 8.0D as brier")
    stats = stats.where("experiment = 'A' or group_id % 10 > 0")
    got = {(r["experiment"], r["replicate"]): r for r in bs.twister_metrics(stats, 3, 8).collect()}
    slow = {(r["experiment"], r["replicate"]): r for r in bs.replicate_metrics(stats, bs.twister_sample(stats, 3, 8)).collect()}
    assert got.keys() == slow.keys() and len(got) == 6
    assert all(got[k][c] == pytest.approx(slow[k][c], rel=1e-12) for k in got for c in ("nll", "brier", "macro_f1", "f1_1", "recall_1", "balanced_accuracy"))
    for k, indices in enumerate(bs.drawn(n, 3, 8)):
        size = sum(i % 2 + i % 3 + i % 5 + i % 7 for i in indices)
        assert got["A", k]["nll"] == pytest.approx(sum(i / 10 for i in indices) / size)


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_the_twister_query_draws_all_replicates(spark):
    from annotide.plans.resampling import bootstrap_mt19937

    assert {r["n_valid"] + r["n_unavailable"] for r in bootstrap_mt19937(spark, str(SF)).collect()} == {bs.REPLICATES} == {5_000}


def test_percentile_interval_is_linear(spark):
    df = spark.createDataFrame([("E", i, float(i)) for i in range(5)], "experiment string, replicate long, m double")
    r = bs.intervals(df, level=0.8).first()
    assert (r["low"], r["high"], r["n_valid"]) == (pytest.approx(0.4), pytest.approx(3.6), 5)


def test_clusters_must_match(spark):
    a = facts(spark, [(0, 0, 0.1, 0.0)] * 3, "A").union(facts(spark, [(0, 0, 0.1, 0.0)] * 2, "B"))
    assert bs.clusters_match(bs.group_statistics(a)).count() == 1


def test_seeds(spark):
    v = spark.createDataFrame([("A", s, "f", float(s)) for s in range(3)] + [("B", s, "f", 2.0 * s) for s in range(3)], "experiment string, seed int, metric string, value double")
    r = {x["experiment"]: x for x in mt.seed_summary(v).collect()}
    assert r["A"]["mean"] == 1 and r["A"]["sd"] == 1 and r["B"]["most"] == 4
    assert sorted(x["difference"] for x in mt.paired_seed_differences(v, "A", "B").collect()) == [-2, -1, 0]


def test_hash_draws_are_poisson_and_uncorrelated():
    times = bs.hash_times(np.arange(400), np.arange(1500)).astype(float)
    assert times.mean() == pytest.approx(1, abs=0.01) and times.var() == pytest.approx(1, abs=0.02) and times.max() >= 7
    assert abs(times.mean(axis=1) - 1).max() < 0.15 and abs(times.mean(axis=0) - 1).max() < 0.3
    for a, b in ((times[1:], times[:-1]), (times[:, 1:], times[:, :-1]), (times[2:, 1:], times[:-2, :-1])):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.01


def test_hash_metrics_equal_a_plain_sum(spark):
    r = np.random.default_rng(1)
    rows = [(e, int(g), *map(int, r.integers(0, 5, 4)), 9, float(g % 7), 0.5) for e in ("a", "b") for g in range(40)]
    names = ["experiment", "group_id", "tn", "fp", "fn", "tp", "n", "nll", "brier"]
    stats = spark.createDataFrame(rows, "experiment string, group_id long, tn long, fp long, fn long, tp long, n long, nll double, brier double").repartition(3)
    times = bs.hash_times(np.arange(40), np.arange(20))
    sample = spark.createDataFrame([(k, g, int(times[g, k])) for k in range(20) for g in range(40) if times[g, k]], "replicate long, group_id long, times long")
    want = {(x["experiment"], x["replicate"]): x for x in bs.replicate_metrics(stats, sample).collect()}
    got = bs.hash_metrics(stats, 20).collect()
    assert len(got) == len(want) and len(names) == 9
    for x in got:
        for c in ("nll", "brier", "macro_f1", "recall_1"):
            assert x[c] == pytest.approx(want[x["experiment"], x["replicate"]][c])


def test_running_sums_over_parts_equal_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(mt, "SCORE_PARTS", 3)
    values = [-math.inf, -1e9, -2.0, -0.5, 0.0, 1e-9, 0.3, 0.31, 0.99, 1.0, 7.0, 1e12, math.inf, math.nan]
    rows = spark.createDataFrame([(e, v, float(k + 1)) for e in "ab" for k, v in enumerate(values)], "experiment string, score double, n double").repartition(3)
    for descending in (False, True):
        got = {(r["experiment"], r["n"]): r["upto_n"] for r in mt.running_sums(rows, "score", ("n",), descending).collect()}
        n = len(values)
        assert got == {(e, float(k)): float(sum(range(k, n + 1)) if descending else sum(range(1, k + 1))) for e in "ab" for k in range(1, n + 1)}
