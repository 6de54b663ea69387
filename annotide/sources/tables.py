"""Strict scans and sinks of delimited and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLES = T.StructType([T.StructField(n, T.StringType()) for n in ("preceding", "target", "following", "A1_Score", "A2_Score", "A3_Score")])


def strict_csv(spark: SparkSession, path: str, schema: T.StructType = TRIPLES, multiline: bool = True) -> DataFrame:
    """Every record as it is, or an error: header and number of fields must fit; empty fields are empty texts.

    ``multiline`` allows line breaks within fields, at the price of one task a file; many files still run in parallel.
    """
    df = spark.read.csv(path, schema=schema, header=True, multiLine=multiline, quote='"', escape='"', mode="FAILFAST", enforceSchema=False, encoding="UTF-8")
    return df.select(*(F.coalesce(f.name, F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in schema.fields))


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The first line's names of the first file, without a byte order mark; duplicates raise."""
    import csv

    first = spark.read.text(path).first()
    names = next(csv.reader([first["value"].lstrip("﻿")])) if first else []
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate columns in {path}")
    return names


def numbered(df: DataFrame, name: str = "source_row") -> DataFrame:
    """Record numbers from 1 on, in the order of the partitions; for a file read as one split that is its own order.

    Partition sizes are counted first and their offsets added, so no window over all rows is needed.
    """
    parts = df.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row a partition
    offsets, at = {}, 0
    for r in sizes:
        offsets[r["_part"]] = at
        at += r["n"]
    table = df.sparkSession.createDataFrame(list(offsets.items()) or [(0, 0)], "_part int, _off long")
    place = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(F.broadcast(table), "_part").select((place + F.col("_off") + 1).alias(name), *df.columns)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None, digits: int | None = None) -> None:
    """Fixed columns in order, doubles optionally with ``digits`` significant digits, booleans as True and False."""
    chosen = df.select(*(columns or df.columns))
    out = []
    for f in chosen.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType) and digits:
            c = F.format_string(f"%.{digits}g", c)
        elif isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        out.append(c.alias(f.name))
    chosen.select(*out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def write_units(df: DataFrame, path: str, units: tuple[str, ...] = ("experiment", "seed")) -> None:
    """One folder a unit; a unit that is written again replaces its own folder only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*units).parquet(path)
