import json
import random

import pytest

from annotide.sources import provenance as pv
from annotide.sources import raw_records as rr
from annotide.sources import tables as tb

GOOD = '"a, ""b""",t,"x\ny",0, 1,"-1"'


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (GOOD, None), (',t,,0,0,0', None), ('"",t,"","0","1","\t1"', None), ('a"b,t,c,0,0,0', "quoting"), ('"a"b,t,c,0,0,0', "quoting"), ('"a,t,c,0,0,0', "quoting"), ('"a""",t,"c,0,0', "quoting"),
        ("a,t,c,0,0", "column_count"), ("a,t,c,0,0,0,0", "column_count"), ("", "column_count"), ("a,t,c,2,0,0", "score_value"), ("a,,c,,0,0", "score_value"), ("a,  ,c,0,0,0", "target_empty"), ('a,"",c,0,0,0', "target_empty"),
    ],
)
def test_reasons(record, reason):
    assert rr.examine(record)[0] == reason


def _edited(record, edits):
    out, gone = [], {at for what, at in edits if what.startswith("delete")}
    for i in range(len(record) + 1):
        out += ['"' if "quote" in what else "," for what, at in edits if what.startswith("insert") and at == i]
        if i < len(record) and i not in gone:
            out.append(record[i])
    return "".join(out)


SMALL = {"fields": ("p", "target", "s"), "scores": ("s",), "target": "target"}


def _valid(record):
    values = rr.split_fields(record)
    return values is not None and len(values) == 3 and values[1].strip() != "" and values[2].strip() in rr.LABELS


def _least(record, most):
    """Brute force over all insertions and deletions."""
    seen, layer = {record}, {record}
    for k in range(most + 1):
        if any(map(_valid, layer)):
            return k
        further = {x[:i] + c + x[i:] for x in layer for i in range(len(x) + 1) for c in '",'}
        further |= {x[:i] + x[i + 1 :] for x in layer for i in range(len(x)) if x[i] in '",'}
        layer = further - seen
        seen |= layer
    return None


@pytest.mark.parametrize("seed", range(3))
def test_edits_are_the_fewest_and_make_a_valid_row(seed):
    r = random.Random(seed)
    for _ in range(200):
        record = "".join(r.choice('",,a01- ') for _ in range(r.randrange(1, 10)))
        least = _least(record, 2)
        edits, valid = rr.cheapest_edits(record, **SMALL)
        if least is None:
            assert not valid or len(edits) > 2, record
        else:
            assert valid and len(edits) == least and _valid(_edited(record, edits)), record


@pytest.mark.parametrize(
    ("record", "cost"), [('a,"b" x,c,1,0,1', 2), ("p,t, he said, f,1,0,-1", 1), ("p,t,f,10,1", 1), ("p,t,f,1 0,1", 1), ('p,"t,f,1,0,1', 1), ('a,b "c" d,e,1,1,0', 2)]
)
def test_repairs_are_valid_rows(record, cost):
    edits, valid = rr.cheapest_edits(record)
    assert valid and len(edits) == cost
    assert rr.examine(_edited(record, edits))[0] is None
    assert rr.examine(record)[2] == cost


def test_records_of_any_length_are_told_in_full():
    record = 'some, text "quoted" here 10 ' * 300 + ",t,f,1,0,1"
    reason, detail, cost, _ = rr.examine(record)
    assert reason == "quoting" and detail.count(";") == cost - 1 > 500
    edits, valid = rr.cheapest_edits(record)
    assert valid and rr.examine(_edited(record, edits))[0] is None


def test_parsed_records(spark):
    rows = [(1, GOOD, "x"), (2, "bad", "x"), (None, GOOD, "x"), (4, None, "x"), (1, GOOD, "x"), (5, '"' + "z" * 300_000, "x")]
    df = spark.createDataFrame(rows, "raw_id long, raw_text string, reason string")
    parsed = rr.parsed_records(df)
    assert parsed.count() == 6
    assert sorted((r["raw_id"], r["reason"]) for r in rr.failed_records(parsed).collect()) == [(2, "column_count"), (4, "target_empty"), (5, "quoting")]
    good = rr.loaded_records(parsed).where("raw_id = 1").first()
    assert (good["preceding"], good["following"], good["A2_Score"], good["A3_Score"]) == ('a, "b"', "x\ny", 1, -1)
    assert rr.parsed_records(df.limit(0)).count() == 0


def test_strict_csv(spark, tmp_path):
    head = "preceding,target,following,A1_Score,A2_Score,A3_Score\n"
    good = tmp_path / "good.csv"
    good.write_text("﻿" + head + '"a\nb",t,,0,1,-1\n"",t2,"q ""x""",0,0,0\n', encoding="utf-8")
    rows = tb.numbered(tb.strict_csv(spark, str(good))).orderBy("source_row").collect()
    assert [(r["source_row"], r["preceding"], r["following"]) for r in rows] == [(1, "a\nb", ""), (2, "", 'q "x"')]
    assert tb.header_of(spark, str(good)) == head.strip().split(",")
    for name, text in (("short", head + "a,b,c\n"), ("header", head.replace("target", "other") + "a,b,c,0,0,0\n")):
        bad = tmp_path / f"{name}.csv"
        bad.write_text(text)
        with pytest.raises(Exception):  # noqa: B017
            tb.strict_csv(spark, str(bad)).collect()
    twice = tmp_path / "twice.csv"
    twice.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        tb.header_of(spark, str(twice))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1, True)], "experiment string, v double, ok boolean")
    tb.write_csv(df.coalesce(1), str(tmp_path / "out"), digits=3)
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "experiment,v,ok\na,0.100,True\n"
    units = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0)], "experiment string, seed int, v double")
    tb.write_units(units, str(tmp_path / "units"))
    tb.write_units(units.where("seed = 2").selectExpr("experiment", "seed", "v + 1 as v"), str(tmp_path / "units"))
    assert sorted((r["seed"], r["v"]) for r in spark.read.parquet(str(tmp_path / "units")).collect()) == [(1, 1.0), (2, 3.0)]


def test_numbering_over_many_partitions(spark):
    got = tb.numbered(spark.range(97).repartition(7)).collect()
    assert sorted(r["source_row"] for r in got) == list(range(1, 98))


def test_staged_publication(tmp_path):
    source = tmp_path / "in.txt"
    source.write_text("x")
    target = tmp_path / "out"
    with pv.staged(target, {str(source): pv.file_sha256(source)}) as stage:
        (stage / "a").write_text("1")
    assert (target / "a").read_text() == "1"
    with pytest.raises(RuntimeError), pv.staged(target, {str(source): pv.file_sha256(source)}) as stage:
        (stage / "a").write_text("2")
        source.write_text("y")
    assert (target / "a").read_text() == "1" and sorted(p.name for p in tmp_path.iterdir()) == ["in.txt", "out"]


def test_status_receipt_and_policy(tmp_path):
    status = tmp_path / "status.json"
    with pytest.raises(ValueError):
        pv.write_status(status, "COMPLETED")
    pv.write_status(status, "RUNNING")
    pv.write_status(status, "COMPLETED", rows=3)
    assert json.loads(status.read_text())["rows"] == 3
    receipt = tmp_path / "receipt"
    assert pv.claim_receipt(receipt, {"a": "1"}) == "claimed" and pv.claim_receipt(receipt, {"a": "1"}) == "resumed"
    with pytest.raises(RuntimeError):
        pv.claim_receipt(receipt, {"a": "2"})
    old, new = tmp_path / "p1.json", tmp_path / "p2.json"
    pv.freeze(old, {"threshold": 0.6, "seed": 1})
    with pytest.raises(RuntimeError):
        pv.freeze(old, {"threshold": 0.7, "seed": 1})
    pv.amend(old, new, {"threshold": 0.7}, "why")
    assert pv.thaw(new)["threshold"] == 0.7
    with pytest.raises(ValueError):
        pv.amend(old, tmp_path / "p3.json", {"other": 1}, "why")
    old.write_text(old.read_text().replace("0.6", "0.9"))
    with pytest.raises(RuntimeError):
        pv.thaw(old)


def test_manifests_and_guards(tmp_path):
    (tmp_path / "a").write_text("1")
    before = pv.manifest_of(tmp_path)
    (tmp_path / "a").write_text("2")
    (tmp_path / "b.pkl").write_text("")
    assert pv.changed(before, pv.manifest_of(tmp_path)) == [("a", "altered"), ("b.pkl", "added")]
    assert pv.prohibited(tmp_path, ("*.pkl",)) == ["b.pkl"]
    with pytest.raises(ValueError):
        pv.within(tmp_path, "../x")
    assert pv.digest({"b": 1, "a": [1.5]}) == pv.digest({"a": [1.5], "b": 1})
    with pytest.raises(ValueError):
        pv.canonical_json(float("nan"))
    config = tmp_path / "c.json"
    config.write_text('{"seed": 42}')
    assert pv.load_config(config, {"seed": int}, {"seed": 42})["seed"] == 42
    with pytest.raises(ValueError):
        pv.load_config(config, {"name": str})
