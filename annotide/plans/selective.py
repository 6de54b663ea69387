"""Calibration and selective prediction over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import selective as sl
from annotide.operators.metrics import rounded
from annotide.plans.common import BULK, SCORES, bulk_scores, scores

GRID = (0.5, 0.75, 1.0, 1.5, 2.0, 4.0)


def temperature_grid(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sl.temperature_grid(scores(spark, sf), GRID), ("temperature",), 6)


def temperature_fit(spark: SparkSession, sf: str) -> DataFrame:
    return sl.fit_temperature(scores(spark, sf))


def calibrated_probs(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities at the best temperature of the grid, and whether a decision changed."""
    best = sl.temperature_grid(scores(spark, sf), GRID).groupBy("experiment").agg(F.min(F.struct(F.round("nll", 9).alias("nll"), F.abs(F.log("temperature")).alias("far"), "temperature")).alias("b")).select("experiment", F.col("b.temperature").alias("temperature"))
    rows = sl.calibrated(scores(spark, sf), best)
    return rows.groupBy("experiment", "temperature").agg(F.count("*").alias("n"), F.count_if(~F.col("decision_kept")).alias("n_changed"), F.round(F.avg("p_uncalibrated"), 6).alias("mean_before"), F.round(F.avg("p_calibrated"), 6).alias("mean_after"))


def risk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sl.risk_coverage(scores(spark, sf)), ("threshold",), 6)


def risk_coverage_bulk(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sl.risk_coverage(bulk_scores(spark, sf)), ("threshold",), 6).select("experiment", "threshold", "accepted", "accepted_errors", "coverage", "risk")


def policy_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sl.policy_candidates(rounded(sl.risk_coverage(scores(spark, sf)), ("threshold",), 9)), ("threshold",), 6)


def operating_point(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sl.operating_point(scores(spark, sf)), (), 6)


def wilson(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the error rate of each experiment and group."""
    per = scores(spark, sf).groupBy("experiment", "group_id").agg(F.count("*").alias("n"), F.count_if(F.col("y") != F.col("pred")).alias("errors"))
    low, high = sl.wilson(F.col("errors"), F.col("n"))
    return rounded(per.select("experiment", "group_id", "n", "errors", low.alias("low"), high.alias("high")), (), 6)


def accepted_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by status at 0.60 and by decision under both tie rules."""
    rows = scores(spark, sf)
    return rows.groupBy("experiment", sl.accept_status(F.greatest(F.col("p"), 1 - F.col("p"))).alias("status"), sl.hard_decision(F.col("l0"), F.col("l1")).alias("decision"), sl.hard_decision(F.col("l0"), F.col("l1"), False).alias("strict_decision")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (temperature_grid, temperature_fit, calibrated_probs, risk_coverage, risk_coverage_bulk, policy_candidates, operating_point, wilson, accepted_predictions)}

_T = ", ".join(f"({t!r}::DOUBLE)" for t in GRID)
_GRID = f"""grid AS (SELECT experiment, t AS temperature, avg(greatest(gap / t, 0) + ln(1 + exp(-abs(gap / t)))) AS nll FROM (SELECT experiment, CASE WHEN y = 1 THEN l0 - l1 ELSE l1 - l0 END AS gap FROM f), (VALUES {_T}) v(t) GROUP BY 1, 2)"""
_P = lambda t: f"1 / (1 + exp(-(l1 - l0) / {t}))"
_CURVE = """th AS (SELECT n / 100::DOUBLE AS threshold FROM range(50, 100) r(n)),
c AS (SELECT f.experiment, th.threshold, count(*) AS total, sum(y)::BIGINT AS pos, count(*) FILTER (WHERE conf >= threshold) AS accepted, count(*) FILTER (WHERE conf >= threshold AND y <> pred) AS accepted_errors,
 count(*) FILTER (WHERE conf >= threshold AND y = 1) AS apos, count(*) FILTER (WHERE conf >= threshold AND y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE conf >= threshold AND y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE conf >= threshold AND y = 1 AND pred = 0) AS fn FROM f, th GROUP BY 1, 2),
curve AS (SELECT experiment, threshold, accepted, total - accepted AS abstained, accepted_errors, accepted / total AS coverage, accepted_errors / nullif(accepted, 0) AS risk, apos / nullif(pos, 0) AS coverage_1, (accepted - apos) / nullif(total - pos, 0) AS coverage_0,
 tp / nullif(tp + fp, 0) AS accepted_precision_1, tp / nullif(tp + fn, 0) AS accepted_recall_1, tp / nullif(pos, 0) AS recall_1_with_abstentions, CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END AS accepted_f1_1 FROM c)"""
_R = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_Z = f"{sl.Z95!r}::DOUBLE"
_WILSON = lambda k, n: (
    f"CASE WHEN {n} > 0 THEN greatest(0, ({k} / {n} + {_Z} * {_Z} / (2 * {n}) - {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {_Z} * {_Z} / {n})) END",
    f"CASE WHEN {n} > 0 THEN least(1, ({k} / {n} + {_Z} * {_Z} / (2 * {n}) + {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4 * {n}::DOUBLE * {n}))) / (1 + {_Z} * {_Z} / {n})) END",
)
_LOW, _HIGH = _WILSON("errors", "n")
_OLOW, _OHIGH = _WILSON("accepted_errors", "accepted")
SQL = {
    "temperature_grid": f"WITH {SCORES}, {_GRID} SELECT experiment, temperature, round(nll, 6) AS nll FROM grid",
    "calibrated_probs": f"""WITH {SCORES}, {_GRID}, b AS (SELECT experiment, temperature FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY round(nll, 9), abs(ln(temperature)), temperature) AS k FROM grid) WHERE k = 1),
q AS (SELECT f.experiment, temperature, {_P('1')} AS p0, {_P('temperature')} AS p1 FROM f JOIN b ON b.experiment = f.experiment) SELECT experiment, temperature, count(*) AS n, count(*) FILTER (WHERE (p0 >= 0.5) <> (p1 >= 0.5)) AS n_changed, round(avg(p0), 6) AS mean_before, round(avg(p1), 6) AS mean_after FROM q GROUP BY 1, 2""",
    "risk_coverage": f"WITH {SCORES}, {_CURVE} SELECT experiment, threshold, accepted, abstained, accepted_errors, {_R('coverage', 'risk', 'coverage_1', 'coverage_0', 'accepted_precision_1', 'accepted_recall_1', 'recall_1_with_abstentions', 'accepted_f1_1')} FROM curve",
    "risk_coverage_bulk": f"WITH {BULK}, {_CURVE} SELECT experiment, threshold, accepted, accepted_errors, {_R('coverage', 'risk')} FROM curve",
    "policy_candidates": f"""WITH {SCORES}, {_CURVE}, u AS (SELECT experiment, threshold, round(coverage, 9) AS coverage, round(risk, 9) AS risk, coverage_0, coverage_1 FROM curve),
p AS (SELECT experiment, 'fixed_' || printf('%.2f', threshold) AS policy, threshold, coverage, risk FROM u WHERE threshold IN (0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE) UNION ALL
 SELECT experiment, 'coverage_' || printf('%.2f', floor), threshold, coverage, risk FROM (SELECT *, row_number() OVER (PARTITION BY experiment, floor ORDER BY risk, coverage DESC, threshold) AS k FROM u, (VALUES (0.9::DOUBLE), (0.8::DOUBLE), (0.7::DOUBLE)) v(floor) WHERE coverage_0 > 0 AND coverage_1 > 0 AND coverage >= floor) WHERE k = 1)
SELECT experiment, policy, threshold, {_R('coverage', 'risk')} FROM p""",
    "operating_point": f"""WITH {SCORES}, s AS (SELECT experiment, count(*) AS n, count(*) FILTER (WHERE conf >= 0.6::DOUBLE) AS accepted, count(*) FILTER (WHERE conf >= 0.6::DOUBLE AND y <> pred) AS accepted_errors, count(*) FILTER (WHERE conf < 0.6::DOUBLE AND y <> pred) AS abstained_errors,
 count(*) FILTER (WHERE pred = 1) AS p1, count(*) FILTER (WHERE pred = 1 AND conf >= 0.6::DOUBLE) AS a1, count(*) FILTER (WHERE pred = 0) AS p0, count(*) FILTER (WHERE pred = 0 AND conf >= 0.6::DOUBLE) AS a0 FROM f GROUP BY 1)
SELECT experiment, accepted, n - accepted AS abstained, accepted_errors, abstained_errors, round(abstained_errors / nullif(accepted_errors + abstained_errors, 0), 6) AS error_concentration, round(a1 / nullif(p1, 0), 6) AS coverage_predicted_1, round(a0 / nullif(p0, 0), 6) AS coverage_predicted_0,
 round({_OLOW}, 6) AS risk_low, round({_OHIGH}, 6) AS risk_high FROM s""",
    "wilson": f"WITH {SCORES}, s AS (SELECT experiment, group_id, count(*) AS n, count(*) FILTER (WHERE y <> pred) AS errors FROM f GROUP BY 1, 2) SELECT experiment, group_id, n, errors, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM s",
    "accepted_predictions": f"WITH {SCORES} SELECT experiment, CASE WHEN conf >= 0.6::DOUBLE THEN 'accepted' ELSE 'abstained' END AS status, (l1 >= l0)::INT AS decision, (l1 > l0)::INT AS strict_decision, count(*) AS n FROM f GROUP BY ALL",
}
