"""Groups and partitions of the annotated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.functions.text import identifier
from annotide.operators import partition as pt
from annotide.storage import Scratch, table


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """One row a window that has a group and a label: example_id, group_id, hard_label, partition."""
    targets = table(spark, sf, "targets").select("example_id", identifier("rule_b_group_id").alias("group_id"), "hard_label").dropna()
    targets = targets.groupBy("example_id").agg(F.min("group_id").alias("group_id"), F.min("hard_label").alias("hard_label"))
    return targets.join(table(spark, sf, "split_manifest").groupBy("example_id").agg(F.min("partition").alias("partition")), "example_id")


def group_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf)
    return pt.group_records(rows, rows)


def _assigned(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf)
    return pt.group_records(rows, rows).join(rows.groupBy("group_id").agg(F.min("partition").alias("partition")), "group_id")


def partition_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    d = pt.diagnostics(_assigned(spark, sf))
    return d.select("partition", "groups", *pt.KINDS, *(F.round(f"{p}_{k}", 6).alias(f"{p}_{k}") for p in ("target", "deviation") for k in pt.KINDS))


def allocation_objective(spark: SparkSession, sf: str) -> DataFrame:
    return pt.objective(pt.diagnostics(_assigned(spark, sf))).select(F.round("objective", 6).alias("objective"))


def balance_checks(spark: SparkSession, sf: str) -> DataFrame:
    return pt.balance_checks(pt.diagnostics(_assigned(spark, sf)))


def greedy_allocation(spark: SparkSession, sf: str) -> DataFrame:
    groups = Scratch(spark, "allocation").write(group_records(spark, sf), "groups")
    return pt.allocate(groups)


def greedy_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return pt.manifest(_records(spark, sf).select("example_id", "group_id"), greedy_allocation(spark, sf))


QUERIES = {f.__name__: f for f in (group_records, partition_diagnostics, allocation_objective, balance_checks, greedy_allocation, greedy_manifest)}

_ID = "nullif(lower(regexp_replace(rule_b_group_id, '^\\s+|\\s+$', '', 'g')), '')"
_RECORDS = f"""rec AS (SELECT t.*, p.part FROM (SELECT example_id, min({_ID}) AS group_id, min(hard_label) AS hard FROM targets WHERE {_ID} IS NOT NULL AND hard_label IS NOT NULL GROUP BY 1) t
 JOIN (SELECT example_id, min("partition") AS part FROM split_manifest GROUP BY 1) p USING (example_id)),
grp AS (SELECT group_id, count(*) AS examples, count(*) FILTER (WHERE hard = 1) AS positive, count(*) FILTER (WHERE hard = 0) AS other, min(part) AS part FROM rec GROUP BY 1),
per AS (SELECT part, count(*) AS groups, sum(examples)::BIGINT AS examples, sum(positive)::BIGINT AS positive, sum(other)::BIGINT AS other, CASE part WHEN 'train' THEN 0.7::DOUBLE WHEN 'test' THEN 0.15::DOUBLE ELSE 0.075::DOUBLE END AS share FROM grp GROUP BY part),
tot AS (SELECT *, sum(examples) OVER () * share AS te, sum(positive) OVER () * share AS tp, sum(other) OVER () * share AS tt, sum(examples) OVER () AS ae, sum(positive) OVER () AS ap, sum(other) OVER () AS ao FROM per)"""
SQL = {
    "group_records": f"WITH {_RECORDS} SELECT group_id, examples, positive, other FROM grp",
    "partition_diagnostics": f"""WITH {_RECORDS} SELECT part AS "partition", groups, examples, positive, other, round(te, 6) AS target_examples, round(tp, 6) AS target_positive, round(tt, 6) AS target_other,
 round(examples - te, 6) AS deviation_examples, round(positive - tp, 6) AS deviation_positive, round(other - tt, 6) AS deviation_other FROM tot""",
    "allocation_objective": f"WITH {_RECORDS} SELECT round(sum((examples - te) ** 2 / greatest(te, 1) + (positive - tp) ** 2 / greatest(tp, 1) + (other - tt) ** 2 / greatest(tt, 1)), 6) AS objective FROM tot",
    "balance_checks": f"""WITH {_RECORDS}
SELECT part || '_fraction' AS check, abs(examples / ae - share) <= 0.02::DOUBLE + 1e-12::DOUBLE AS passed FROM tot
UNION ALL SELECT part || '_rate', abs(positive / examples - ap / ae) <= 0.03::DOUBLE + 1e-12::DOUBLE FROM tot
UNION ALL SELECT part || '_classes', positive > 0 AND other > 0 FROM tot""",
}
