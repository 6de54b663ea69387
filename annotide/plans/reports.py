"""Validators, rule comparison and publication tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import checks, overlap
from annotide.operators import metrics as mt
from annotide.operators import selective as sl
from annotide.plans.common import SCORES, audited, scores
from annotide.plans.metrics import _BIN, _CELLS
from annotide.plans.overlap import SQL as OVERLAP
from annotide.plans.overlap import _index, _sql_groups, leakage_check
from annotide.storage import table

TEMPERATURE = 1.5


def partition_validation(spark: SparkSession, sf: str) -> DataFrame:
    return checks.partition_checks(table(spark, sf, "split_manifest"), table(spark, sf, "targets"), table(spark, sf, "autalic"), leakage_check(spark, sf))


def short_merges(spark: SparkSession, sf: str) -> DataFrame:
    index = _index(spark, sf)
    return overlap.short_merges(index, overlap.groups(audited(spark, sf).where("eligible"), index, "a"))


def flattened_confusion(spark: SparkSession, sf: str) -> DataFrame:
    """The confusion matrix of each experiment in one cell."""
    cells = mt.confusion(scores(spark, sf))
    return cells.select("experiment", F.to_json(F.array(F.array("tn", "fp"), F.array("fn", "tp"))).alias("confusion_matrix"))


def calibration_effect(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics before and after a temperature, and what it changed."""
    rows = scores(spark, sf)
    after = rows.withColumn("p", sl.softmax_positive(F.col("l0"), F.col("l1"), TEMPERATURE))
    pick = lambda df, name: mt.unpivoted(mt.probability_metrics(df).select("experiment", "nll", "brier", "ece")).withColumnRenamed("value", name)
    joined = pick(rows, "uncalibrated").join(pick(after, "calibrated"), ["experiment", "metric"])
    return mt.rounded(joined.select("experiment", "metric", "uncalibrated", "calibrated", (F.col("calibrated") - F.col("uncalibrated")).alias("difference")), (), 6)


QUERIES = {f.__name__: f for f in (partition_validation, short_merges, flattened_confusion, calibration_effect)}

_Q = "least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
_STATE = lambda src, name: f"""{name}_m AS (SELECT experiment, avg(-(y * ln({_Q}) + (1 - y) * ln(1 - {_Q}))) AS nll, avg((p - y) ** 2) AS brier FROM {src} GROUP BY 1),
{name}_e AS (SELECT experiment, sum(abs(sp - sy)) / sum(n) AS ece FROM (SELECT experiment, {_BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM {src} GROUP BY 1, 2) GROUP BY 1),
{name} AS (UNPIVOT (SELECT experiment, nll, brier, ece FROM {name}_m JOIN {name}_e USING (experiment)) ON nll, brier, ece INTO NAME metric VALUE value)"""  # noqa: E731
SQL = {
    "partition_validation": f"""WITH leaks AS ({OVERLAP['leakage_check']}), v AS (SELECT 'one_partition_a_record' AS check, (SELECT count(*) FROM (SELECT source_row FROM split_manifest GROUP BY 1 HAVING count(DISTINCT "partition") > 1)) AS n_violations
UNION ALL SELECT 'known_partitions', (SELECT count(*) FROM split_manifest WHERE "partition" NOT IN ('train', 'dev_tune', 'dev_calibration', 'test'))
UNION ALL SELECT 'outer_split_fits', (SELECT count(*) FROM split_manifest WHERE outer_split <> CASE "partition" WHEN 'train' THEN 'train' WHEN 'test' THEN 'test' ELSE 'development' END)
UNION ALL SELECT 'rows_of_the_source', (SELECT count(DISTINCT source_row) FROM split_manifest WHERE source_row NOT IN (SELECT source_row FROM autalic))
UNION ALL SELECT 'target_for_each_row', (SELECT count(DISTINCT source_row) FROM split_manifest WHERE source_row NOT IN (SELECT source_row FROM targets))
UNION ALL SELECT 'no_text_in_two_partitions', (SELECT count(*) FROM leaks)) SELECT "check", n_violations, n_violations = 0 AS passed FROM v""",
    "short_merges": f"""WITH {_sql_groups(('a',))} SELECT sha256(value) AS normalized_text_sha256, words, count(DISTINCT example_id) AS n_examples, count(DISTINCT group_id) AS n_groups
FROM idx JOIN g_a USING (example_id) WHERE setting = 'whitespace_casefold' AND words < 5 GROUP BY value, words HAVING count(DISTINCT group_id) > 1""",
    "flattened_confusion": f"WITH {SCORES}, c AS (SELECT experiment, {_CELLS} FROM f GROUP BY 1) SELECT experiment, '[[' || tn || ',' || fp || '],[' || fn || ',' || tp || ']]' AS confusion_matrix FROM c",
    "calibration_effect": f"WITH {SCORES}, h AS (SELECT experiment, y, 1 / (1 + exp(-(l1 - l0) / {TEMPERATURE}::DOUBLE)) AS p FROM f), {_STATE('f', 'a')}, {_STATE('h', 'b')} SELECT a.experiment, a.metric, round(a.value, 6) AS uncalibrated, round(b.value, 6) AS calibrated, round(b.value - a.value, 6) AS difference FROM a JOIN b ON a.experiment = b.experiment AND a.metric = b.metric",
}
