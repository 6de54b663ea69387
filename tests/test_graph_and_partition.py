import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annotide.operators import overlap
from annotide.operators import partition as pt
from annotide.operators.components import connected_components
from annotide.operators.labels import derive


def roots(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)] + [(7, None), (300, 300)]
    got = {x["id"]: x["root"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == roots(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def windows(spark, rows):
    data = [(i + 1, f"e{i + 1}", *r, "0", "1", "1") for i, r in enumerate(rows)]
    return derive(spark.createDataFrame(data, "source_row long, example_id string, preceding string, target string, following string, A1_Score string, A2_Score string, A3_Score string"))


def test_rules_and_links(spark):
    rows = windows(spark, [("", "Two words", ""), ("", "two  WORDS", "x"), ("hello you", "a b c d e", ""), ("", "other", "hello you"), ("", "z", "A b c d e")]).where("eligible")
    index = overlap.inverted_index(rows)
    of = lambda rule: {r["example_id"]: r["group_id"] for r in overlap.groups(rows, index, rule).collect()}
    five, a, b = of("five"), of("a"), of("b")
    assert five["e1"] != five["e2"] and a["e1"] == a["e2"] == "rule-a-" + hashlib.sha256(b"e1|e2").hexdigest()[:16]
    assert five["e3"] == five["e5"] and a["e3"] != a["e4"] and b["e3"] == b["e4"] == b["e5"]
    kinds = {(r["comparison_setting"], r["example_id_1"], r["example_id_2"]): r["link_type"] for r in overlap.overlap_links(index).collect()}
    assert kinds["whitespace_casefold", "e1", "e2"] == "target_target_short_or_unthresholded"
    assert kinds["whitespace_casefold", "e3", "e5"] == "target_context_substantial"
    assert kinds["original", "e3", "e4"] == "context_context_short_or_unthresholded" and ("original", "e1", "e2") not in kinds
    assert all(r["n_violations"] == 0 for r in overlap.grouping_checks(rows, index, overlap.groups(rows, index, "a"), overlap.groups(rows, index, "b")).collect())
    swapped = overlap.grouping_checks(rows, index, overlap.groups(rows, index, "b"), overlap.groups(rows, index, "five").where("example_id <> 'x'"))
    assert {r["check"] for r in swapped.collect()} == {f"rule_{k}_{c}" for k in "ab" for c in ("members", "repeated_targets", "long_texts")} | {"rule_a_within_rule_b"}
    assert {(r["n_merged"], r["size"]) for r in overlap.merges(overlap.groups(rows, index, "five"), overlap.groups(rows, index, "b")).collect()} == {(2, 2), (2, 3)}


def test_group_ids_do_not_depend_on_order(spark):
    rows = windows(spark, [("", f"t{i % 5}", "") for i in range(20)]).where("eligible")
    one = {tuple(r) for r in overlap.groups(rows, overlap.inverted_index(rows), "b").collect()}
    back = rows.orderBy(F.desc("source_row"))
    assert one == {tuple(r) for r in overlap.groups(back, overlap.inverted_index(back), "b").collect()}


def test_leakage(spark):
    rows = windows(spark, [("", "same text", ""), ("", "Same text", ""), ("", "else", "")])
    splits = spark.createDataFrame([("e1", "train"), ("e2", "test"), ("e3", "test"), ("e3", "test")], "example_id string, partition string")
    r = overlap.leakage(overlap.inverted_index(rows), splits).collect()
    assert len(r) == 1 and (r[0]["n_partitions"], r[0]["n_examples"], r[0]["words"]) == (2, 2, 2)


def test_notes_are_kept_and_orphans_found(spark):
    kept, orphans = overlap.upsert_notes(spark.createDataFrame([("a",), ("b",)], "case_id string"), spark.createDataFrame([("a", "seen"), ("z", "lost")], "case_id string, note string"))
    assert {r["case_id"]: r["note"] for r in kept.collect()} == {"a": "seen", "b": ""} and [r["case_id"] for r in orphans.collect()] == ["z"]


def test_allocation_is_whole_balanced_and_stable(spark):
    r = random.Random(0)
    groups = [(f"g{i}", n, p, n - p) for i in range(120) for n in [r.choice((1, 1, 2, 5))] for p in [r.randrange(n + 1)]]
    df = spark.createDataFrame(groups, "group_id string, examples long, positive long, other long")
    a = {x["group_id"]: x["partition"] for x in pt.allocate(df, candidates=8).collect()}
    assert a == {x["group_id"]: x["partition"] for x in pt.allocate(df.orderBy(F.desc("group_id")), candidates=8).collect()}
    total = sum(g[1] for g in groups)
    for name, share in pt.SHARES.items():
        assert abs(sum(g[1] for g in groups if a[g[0]] == name) - share * total) <= 0.03 * total
    d = pt.diagnostics(pt.allocate(df, candidates=8))
    assert d.agg(F.sum("groups")).first()[0] == 120 and pt.objective(d).first()[0] < 20
    few = pt.allocate(df, candidates=4, largest=10)
    assert few.where("partition is null").count() == 0 and few.count() == 120


def test_allocation_of_nothing(spark):
    assert pt.allocate(spark.createDataFrame([], "group_id string, examples long, positive long, other long")).count() == 0


def test_a_better_objective_does_not_beat_less_violation(spark):
    r = random.Random(0)
    groups = [(f"g{i}", n, p, n - p) for i in range(40) for n in [r.choice((1, 1, 2, 6, 12))] for p in [n if r.random() < 0.12 else 0]]
    totals = tuple(sum(g[k] for g in groups) for k in (1, 2, 3))
    ranks = []
    for i in range(16):
        counts, places = pt._candidate(groups, totals, pt.SEED + i * pt.STRIDE, pt.SHARES)
        infeasible, violation, objective = 0, 0.0, 0.0
        for (n, pos, other), share in zip(counts, pt.SHARES.values(), strict=True):
            over, rate = max(0, abs(n / totals[0] - share) - 0.02), max(0, abs(pos / n - totals[1] / totals[0]) - 0.03)
            violation += over + rate + (pos == 0 or other == 0)
            infeasible |= over > 0 or rate > 0 or pos == 0 or other == 0
            objective += sum((x - t * share) ** 2 / max(t * share, 1) for x, t in zip((n, pos, other), totals, strict=True))
        ranks.append((infeasible, round(violation, 9), round(objective, 9), "|".join(f"{g[0]}:{p}" for g, p in sorted(zip(groups, places, strict=True))), dict(zip((g[0] for g in groups), places, strict=True))))
    want, by_objective = min(ranks, key=lambda x: x[:4])[4], min(ranks, key=lambda x: x[2])[4]
    got = {x["group_id"]: x["partition"] for x in pt.allocate(spark.createDataFrame(groups, "group_id string, examples long, positive long, other long"), candidates=16).collect()}
    assert got == want != by_objective


def test_candidates_are_judged_with_the_groups_placed_by_hash(spark):
    groups = [(f"g{i}", 1 + i % 3, i % 2, 1 + i % 3 - i % 2) for i in range(300)]
    df = spark.createDataFrame(groups, "group_id string, examples long, positive long, other long")
    totals = tuple(sum(g[k] for g in groups) for k in (1, 2, 3))
    hashes = {r["group_id"]: r["b"] for r in df.select("group_id", F.pmod(F.xxhash64("group_id"), F.lit(pt.BUCKETS)).alias("b")).collect()}
    out = {x["group_id"]: x["partition"] for x in pt.allocate(df, candidates=1, largest=40).collect()}
    head = sorted(groups, key=lambda g: (-g[1], g[0]))[:40]
    counts, _ = pt._candidate(head, totals, pt.SEED, pt.SHARES)
    rest = np.zeros((pt.BUCKETS + 1, 3), np.int64)
    for g in groups:
        if g not in head:
            rest[hashes[g[0]] + 1] += g[1:]
    found = pt._with_rest(counts, rest.cumsum(axis=0), totals[0], pt.SHARES)
    assert found == [[sum(g[k] for g in groups if out[g[0]] == p) for k in (1, 2, 3)] for p in pt.SHARES]
