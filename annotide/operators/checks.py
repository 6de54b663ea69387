"""Validation as rows: check, n_violations, passed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.operators.partition import OUTER


def counted(violations: DataFrame, name: str) -> DataFrame:
    """One row: how many violations there are."""
    return violations.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations", (F.col("n_violations") == 0).alias("passed"))


def partition_checks(manifest: DataFrame, targets: DataFrame, source: DataFrame, leaks: DataFrame) -> DataFrame:
    """What a saved partition must fulfil: one partition a record, outer splits that fit, known rows, a target for each, no shared text."""
    per = manifest.groupBy("source_row").agg(F.min("partition").alias("a"), F.max("partition").alias("b"))
    outer = F.create_map(*(F.lit(x) for pair in OUTER.items() for x in pair))
    ids = manifest.select("source_row").distinct()
    parts = [
        counted(per.where("a <> b"), "one_partition_a_record"),
        counted(manifest.where(~F.col("partition").isin(*OUTER)), "known_partitions"),
        counted(manifest.where(F.col("outer_split").isNotNull() & (F.col("outer_split") != outer[F.col("partition")])), "outer_split_fits"),
        counted(ids.join(source, "source_row", "left_anti"), "rows_of_the_source"),
        counted(ids.join(targets, "source_row", "left_anti"), "target_for_each_row"),
        counted(leaks, "no_text_in_two_partitions"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
