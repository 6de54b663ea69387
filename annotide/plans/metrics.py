"""Metrics of predictions over the events and the line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import metrics as mt
from annotide.plans.common import BULK, SCORES, bulk_scores, scores

PAIRS = [("S1", "S2"), ("S2", "S1")]


def _round(df: DataFrame, keys: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    return mt.rounded(df, keys, digits)


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return mt.confusion(bulk_scores(spark, sf))


def class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.class_metrics(mt.confusion(bulk_scores(spark, sf))))


def class_metrics_nullable(spark: SparkSession, sf: str) -> DataFrame:
    """By group of the events, where many quotients are undefined."""
    return _round(mt.class_metrics(mt.confusion(scores(spark, sf), ("experiment", "group_id")), nullable=True))


def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.roc_auc(scores(spark, sf)).union(mt.roc_auc(bulk_scores(spark, sf))))


def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.average_precision(scores(spark, sf)).union(mt.average_precision(bulk_scores(spark, sf))))


def prob_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.probability_metrics(bulk_scores(spark, sf)))


def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.reliability(scores(spark, sf)))


def brier_skill(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.skill(scores(spark, sf)))


def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.spearman(scores(spark, sf)))


def slice_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    return _round(mt.slice_metrics(rows, [("event_type", F.col("event_type")), ("soft", F.col("example_id") % 4)]))


def model_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.model_agreement(scores(spark, sf)))


def _table(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    named = mt.class_metrics(mt.confusion(rows)).select("experiment", "macro_f1", "recall_1", "accuracy")
    return named.join(mt.roc_auc(rows), "experiment").join(mt.probability_metrics(rows).select("experiment", "nll", "brier"), "experiment")


def paired_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.compared(_table(spark, sf), PAIRS))


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return mt.verdicts(mt.compared(_table(spark, sf).select("experiment", "macro_f1", "recall_1", "roc_auc"), PAIRS))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and Brier score by experiment and seed, where a seed is a tenth of the groups."""
    rows = scores(spark, sf).select("experiment", (F.col("group_id") % 10).alias("seed"), (F.col("y") == F.col("pred")).cast("double").alias("hit"), F.pow(F.col("p") - F.col("y"), F.lit(2.0)).alias("loss"))
    per = rows.groupBy("experiment", "seed").agg(F.avg("hit").alias("accuracy"), F.avg("loss").alias("brier"))
    return per.unpivot(["experiment", "seed"], ["accuracy", "brier"], "metric", "value")


def seed_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.seed_summary(_seeds(spark, sf)))


def paired_seed_differences(spark: SparkSession, sf: str) -> DataFrame:
    return _round(mt.paired_seed_differences(_seeds(spark, sf), "S1", "S2"))


def weighted_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Class-weighted hard and soft cross-entropy."""
    rows = bulk_scores(spark, sf)
    sums = rows.groupBy("experiment").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    y, p, soft = F.col("y"), mt.clipped(F.col("p")), F.col("soft")
    w1, w0 = F.col("n") / (2 * F.col("pos")), F.col("n") / (2 * (F.col("n") - F.col("pos")))
    joined = rows.join(F.broadcast(sums), "experiment")  # a row an experiment
    hard = -F.when(y == 1, w1 * F.log(p)).otherwise(w0 * F.log(1 - p))
    soft_ce = -(w1 * soft * F.log(p) + w0 * (1 - soft) * F.log(1 - p))
    return _round(joined.groupBy("experiment").agg(F.avg(hard).alias("hard_loss"), F.avg(soft_ce).alias("soft_loss")))


QUERIES = {f.__name__: f for f in (
    confusion, class_metrics, class_metrics_nullable, roc_auc, average_precision, prob_metrics, reliability_bins, brier_skill, spearman, slice_metrics, model_agreement, paired_comparison, verdicts,
    seed_summary, paired_seed_differences, weighted_losses,
)}

_CELLS = "count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp"


def _quotients(zero: str, keys: str) -> str:
    """CTE m with the metrics of CTE c (keys, tn, fp, fn, tp)."""
    q = lambda a, b: f"CASE WHEN {b} <> 0 THEN ({a})::DOUBLE / ({b}) ELSE {zero} END"
    f1 = lambda p, r: f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) WHEN {p} IS NULL OR {r} IS NULL THEN NULL ELSE {zero} END"
    return f"""b AS (SELECT {keys}, {q('tp', '(tp + fp)')} AS precision_1, {q('tp', '(tp + fn)')} AS recall_1, {q('tn', '(tn + fn)')} AS precision_0, {q('tn', '(tn + fp)')} AS recall_0, {q('tn + tp', '(tn + fp + fn + tp)')} AS accuracy FROM c),
m0 AS (SELECT *, {f1('precision_1', 'recall_1')} AS f1_1, {f1('precision_0', 'recall_0')} AS f1_0 FROM b), m AS (SELECT *, (f1_0 + f1_1) / 2 AS macro_f1, (recall_0 + recall_1) / 2 AS balanced_accuracy FROM m0)"""


_NAMES = ("precision_1", "recall_1", "precision_0", "recall_0", "accuracy", "f1_1", "f1_0", "macro_f1", "balanced_accuracy")
_ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in _NAMES)
_AUC = """s AS (SELECT experiment, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(n - pos) OVER (PARTITION BY experiment ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s),
auc AS (SELECT experiment, sum(pos * (below + (n - pos) / 2)) / nullif(sum(pos) * (sum(n) - sum(pos)), 0) AS roc_auc FROM k GROUP BY 1)"""
_AP = """s AS (SELECT experiment, p, sum(y)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM f GROUP BY 1, 2), k AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY experiment ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT experiment, sum(pos * tp / seen) / nullif(sum(pos), 0) AS average_precision FROM k GROUP BY 1)"""
_Q = "least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)"
_NLL = f"-(y * ln({_Q}) + (1 - y) * ln(1 - {_Q}))"
_BIN = "CASE " + " ".join(f"WHEN p >= {k / 10}::DOUBLE THEN {k}" for k in range(9, 0, -1)) + " ELSE 0 END"
_MANY = f"""c AS (SELECT experiment, {_CELLS} FROM f GROUP BY 1), {_quotients('0', 'experiment')}, {_AUC}, pm AS (SELECT experiment, avg({_NLL}) AS nll, avg((p - y) ** 2) AS brier FROM f GROUP BY 1),
t AS (UNPIVOT (SELECT experiment, macro_f1, recall_1, accuracy, roc_auc, nll, brier FROM m JOIN auc USING (experiment) JOIN pm USING (experiment)) ON macro_f1, recall_1, accuracy, roc_auc, nll, brier INTO NAME metric VALUE value),
d AS (SELECT l.experiment AS left_experiment, r.experiment AS right_experiment, l.metric, l.value AS left_value, r.value AS right_value, l.value - r.value AS difference FROM t l JOIN t r ON l.metric = r.metric AND l.experiment <> r.experiment)"""
_SEEDS = """per AS (SELECT experiment, group_id % 10 AS seed, avg((y = pred)::INT::DOUBLE) AS accuracy, avg((p - y) ** 2) AS brier FROM f GROUP BY 1, 2), sv AS (UNPIVOT per ON accuracy, brier INTO NAME metric VALUE value)"""
SQL = {
    "confusion": f"WITH {BULK}, c AS (SELECT experiment, {_CELLS} FROM f GROUP BY 1) SELECT *, tn + fp AS support_0, fn + tp AS support_1, fp + tp AS predicted_1 FROM c",
    "class_metrics": f"WITH {BULK}, c AS (SELECT experiment, {_CELLS} FROM f GROUP BY 1), {_quotients('0', 'experiment')} SELECT experiment, {_ROUNDED} FROM m",
    "class_metrics_nullable": f"WITH {SCORES}, c AS (SELECT experiment, group_id, {_CELLS} FROM f GROUP BY 1, 2), {_quotients('NULL', 'experiment, group_id')} SELECT experiment, group_id, {_ROUNDED} FROM m",
    "roc_auc": f"WITH {SCORES}, {_AUC} SELECT experiment, round(roc_auc, 6) AS roc_auc FROM auc UNION ALL (WITH {BULK}, {_AUC} SELECT experiment, round(roc_auc, 6) FROM auc)",
    "average_precision": f"WITH {SCORES}, {_AP} SELECT experiment, round(average_precision, 6) AS average_precision FROM ap UNION ALL (WITH {BULK}, {_AP} SELECT experiment, round(average_precision, 6) FROM ap)",
    "prob_metrics": f"""WITH {BULK}, g AS (SELECT experiment, {_BIN} AS bin, count(*) AS n, sum(p) AS sp, sum(y) AS sy FROM f GROUP BY 1, 2), e AS (SELECT experiment, round(sum(abs(sp - sy)) / sum(n), 6) AS ece FROM g GROUP BY 1)
SELECT experiment, count(*) AS n, round(avg({_NLL}), 6) AS nll, round(avg((p - y) ** 2), 6) AS brier, any_value(e.ece) AS ece, round(avg(p) - avg(y), 6) AS calibration_in_the_large, round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS prevalence,
 round(avg(-(soft * ln({_Q}) + (1 - soft) * ln(1 - {_Q}))), 6) AS soft_ce, round(avg((p - soft) ** 2), 6) AS soft_brier, round(avg(abs(p - soft)), 6) AS soft_mad FROM f JOIN e USING (experiment) GROUP BY experiment""",
    "reliability_bins": f"""WITH {SCORES}, g AS (SELECT experiment, {_BIN} AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM f GROUP BY 1, 2)
SELECT x.experiment, b.bin::INT AS bin, coalesce(g.n, 0) AS n, round(mp, 6) AS mean_p, round(rate, 6) AS rate, round(abs(mp - rate), 6) AS gap FROM (SELECT DISTINCT experiment FROM f) x CROSS JOIN range(10) b(bin) LEFT JOIN g ON g.experiment = x.experiment AND g.bin = b.bin""",
    "brier_skill": f"""WITH {SCORES}, s AS (SELECT experiment, avg(y) AS b, avg((p - y) ** 2) AS brier, avg({_NLL}) AS nll FROM f GROUP BY 1), z AS (SELECT *, b * (1 - b) AS nb, -(b * ln(b) + (1 - b) * ln(1 - b)) AS nn FROM s)
SELECT experiment, round(b, 6) AS base_rate, round(nb, 6) AS null_brier, round(nn, 6) AS null_nll, round(1 - brier / nb, 6) AS brier_skill, round(nn - nll, 6) AS nll_gain FROM z""",
    "spearman": f"""WITH {SCORES}, k AS (SELECT experiment, rank() OVER (PARTITION BY experiment ORDER BY p) + (count(*) OVER (PARTITION BY experiment, p) - 1) / 2::DOUBLE AS a, rank() OVER (PARTITION BY experiment ORDER BY soft) + (count(*) OVER (PARTITION BY experiment, soft) - 1) / 2::DOUBLE AS b FROM f)
SELECT experiment, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY 1""",
    "slice_metrics": f"""WITH {SCORES}, l AS (SELECT experiment, y, pred, 'event_type=' || coalesce(event_type, 'null') AS slice FROM f UNION ALL SELECT experiment, y, pred, 'soft=' || (example_id % 4)::VARCHAR FROM f), c AS (SELECT experiment, slice, {_CELLS} FROM l GROUP BY 1, 2), {_quotients('NULL', 'experiment, slice')}
SELECT c.experiment, c.slice, tn, fp, fn, tp, round(macro_f1, 6) AS macro_f1, round(f1_1, 6) AS f1_1, round(recall_1, 6) AS recall_1, round(accuracy, 6) AS accuracy FROM c JOIN m ON m.experiment = c.experiment AND m.slice = c.slice""",
    "model_agreement": f"WITH {SCORES} SELECT a.experiment AS left_experiment, b.experiment AS right_experiment, count(*) AS n, count(*) FILTER (WHERE a.pred = b.pred) AS n_same, round(avg((a.pred = b.pred)::INT::DOUBLE), 6) AS agreement FROM f a JOIN f b ON a.example_id = b.example_id AND a.experiment < b.experiment GROUP BY 1, 2",
    "paired_comparison": f"WITH {SCORES}, {_MANY} SELECT left_experiment, right_experiment, metric, round(left_value, 6) AS left_value, round(right_value, 6) AS right_value, round(difference, 6) AS difference FROM d",
    "verdicts": f"WITH {SCORES}, {_MANY} SELECT left_experiment, right_experiment, CASE WHEN bool_and(difference > 0) THEN 'favourable' WHEN bool_and(difference < 0) THEN 'unfavourable' ELSE 'mixed' END AS verdict FROM d WHERE metric IN ('macro_f1', 'recall_1', 'roc_auc') GROUP BY 1, 2",
    "seed_summary": f"WITH {SCORES}, {_SEEDS} SELECT experiment, metric, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(min(value), 6) AS least, round(max(value), 6) AS most FROM sv GROUP BY 1, 2",
    "paired_seed_differences": f"WITH {SCORES}, {_SEEDS} SELECT a.seed, a.metric, round(a.value - b.value, 6) AS difference FROM sv a JOIN sv b ON a.seed = b.seed AND a.metric = b.metric AND a.experiment = 'S1' AND b.experiment = 'S2'",
    "weighted_losses": f"""WITH {BULK}, w AS (SELECT experiment, count(*) / (2::DOUBLE * sum(y)) AS w1, count(*) / (2::DOUBLE * (count(*) - sum(y))) AS w0 FROM f GROUP BY 1)
SELECT experiment, round(avg(-CASE WHEN y = 1 THEN w1 * ln({_Q}) ELSE w0 * ln(1 - {_Q}) END), 6) AS hard_loss, round(avg(-(w1 * soft * ln({_Q}) + w0 * (1 - soft) * ln(1 - {_Q}))), 6) AS soft_loss FROM f JOIN w USING (experiment) GROUP BY experiment""",
}
