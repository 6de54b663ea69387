"""The registry, and every query with SQL against DuckDB on the smallest tables."""

import importlib
import sys
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def test_core_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("annotide.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "annotide.llm", None)
    import annotide

    monkeypatch.delattr(annotide, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries().keys()
    assert "vote_summary" in names and "p7_found" in names and "p1_found" not in names
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_sql_is_of_known_queries():
    from annotide import registry

    assert registry.oracle_sql().keys() <= registry.queries().keys()


@needs_data
def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 36


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(importlib.import_module("annotide.registry").oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    from annotide import registry

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, str(SF))
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, found.fetchall())


def test_streaming_equals_batch(spark, tmp_path):
    from annotide.streaming.votes import hourly_votes

    rows = [(1, "a", "2024-01-01 10:05:00", " 1"), (1, "a", "2024-01-01 10:05:00", " 1"), (2, "b", "2024-01-01 10:50:00", "0"), (3, "a", "2024-01-01 11:10:00", "x"), (4, "a", "2024-01-09 11:10:00", "1")]
    df = spark.createDataFrame(rows, "vote_id long, annotator_id string, at string, label string").selectExpr("vote_id", "annotator_id", "to_timestamp(at) as voted_at", "label")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = hourly_votes(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("hourly").collect())) == sorted(map(tuple, hourly_votes(df).collect()))
