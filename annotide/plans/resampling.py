"""Cluster bootstrap of predictions over the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import bootstrap as bs
from annotide.operators.metrics import rounded
from annotide.plans.common import SCORES, scores
from annotide.plans.metrics import _quotients
from annotide.storage import Scratch


def _stats(spark: SparkSession, sf: str) -> DataFrame:
    return Scratch(spark, "bootstrap").write(bs.group_statistics(scores(spark, sf)), "stats")


#: Added before rounding, as means of the twenty-valued score often lie right between two roundings.
OFF_TIES = 1e-9


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    values = bs.hash_metrics(_stats(spark, sf))
    return values.select(*(F.col(c) + OFF_TIES if t == "double" else F.col(c) for c, t in values.dtypes)).toDF(*values.columns)


def bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals over replicates drawn by a hash."""
    return rounded(bs.intervals(_hashed(spark, sf)), (), 6)


def bootstrap_replicates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_hashed(spark, sf), (), 6)


def bootstrap_mt19937(spark: SparkSession, sf: str) -> DataFrame:
    """Intervals of both experiments and of their difference over one Mersenne Twister stream."""
    stats = _stats(spark, sf)
    values = Scratch(spark, "bootstrap").write(bs.twister_metrics(stats, bs.REPLICATES), "values")
    both = values.unionByName(bs.paired_differences(values, "S1", "S2"))
    return bs.intervals(both)


def bootstrap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    stats = _stats(spark, sf)
    return stats.groupBy("experiment").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.round(F.sum("brier"), 4).alias("brier_sum"))


QUERIES = {f.__name__: f for f in (bootstrap_hash, bootstrap_replicates, bootstrap_mt19937, bootstrap_clusters)}

_STATS = """st AS (SELECT experiment, group_id, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) AS n,
 sum(-(y * ln(least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)) + (1 - y) * ln(1 - least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE)))) AS nll, sum((p - y) ** 2) AS brier FROM f WHERE group_id IS NOT NULL GROUP BY 1, 2)"""
_P = bs.PRIME
_VALUES = f"""{_STATS}, u0 AS (SELECT group_id, group_id % {_P} AS g, r FROM (SELECT DISTINCT group_id::BIGINT AS group_id FROM st), range({bs.REPLICATES}) x(r)),
u1 AS (SELECT *, (g * 7919 + r * 104729 + 12345) % {_P} AS x FROM u0), u2 AS (SELECT group_id, g, r, (x * x + g * 31 + r) % {_P} AS x FROM u1), u3 AS (SELECT group_id, g, r, (x * x + g) % {_P} AS x FROM u2),
u AS (SELECT group_id, r AS replicate, ((x * x + r) % {_P}) / {_P}::DOUBLE AS u FROM u3),
s AS (SELECT *, {" + ".join(f"(u >= {q}::DOUBLE)::INT" for q in bs.POISSON)} AS k FROM u),
c AS (SELECT experiment, replicate, sum(tn * k) AS tn, sum(fp * k) AS fp, sum(fn * k) AS fn, sum(tp * k) AS tp, sum(nll * k) / sum(n * k) AS nll, sum(brier * k) / sum(n * k) AS brier FROM s JOIN st USING (group_id) WHERE k > 0 GROUP BY 1, 2),
{_quotients('0', 'experiment, replicate')},
v AS (SELECT c.experiment, c.replicate, c.nll + {OFF_TIES} AS nll, c.brier + {OFF_TIES} AS brier, CASE WHEN ok THEN macro_f1 + {OFF_TIES} END AS macro_f1, CASE WHEN ok THEN f1_1 + {OFF_TIES} END AS f1_1, CASE WHEN ok THEN recall_1 + {OFF_TIES} END AS recall_1, CASE WHEN ok THEN balanced_accuracy + {OFF_TIES} END AS balanced_accuracy
 FROM (SELECT *, tp + fn > 0 AND tn + fp > 0 AS ok FROM c) c JOIN m ON m.experiment = c.experiment AND m.replicate = c.replicate)"""
_NAMES = ("nll", "brier", "macro_f1", "f1_1", "recall_1", "balanced_accuracy")
SQL = {
    "bootstrap_replicates": f"WITH {SCORES}, {_VALUES} SELECT experiment, replicate, " + ", ".join(f"round({n}, 6) AS {n}" for n in _NAMES) + " FROM v",
    "bootstrap_hash": f"WITH {SCORES}, {_VALUES} "
    + " UNION ALL ".join(f"SELECT experiment, '{n}' AS metric, round(quantile_cont({n}, 0.025), 6) AS low, round(quantile_cont({n}, 0.975), 6) AS high, count({n}) AS n_valid, count(*) - count({n}) AS n_unavailable FROM v GROUP BY 1" for n in _NAMES),
    "bootstrap_clusters": f"WITH {SCORES}, {_STATS} SELECT experiment, count(*) AS n_groups, sum(n)::BIGINT AS n_rows, round(sum(brier), 4) AS brier_sum FROM st GROUP BY 1",
}
