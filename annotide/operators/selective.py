"""Calibration by temperature and selective prediction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annotide.operators.metrics import f_score, ratio

# Fixed value: the normal quantile of a two-sided 95 % interval.
Z95 = 1.959963984540054
THRESHOLDS = tuple(n / 100 for n in range(50, 100))


def softmax_positive(l0: Column, l1: Column, temperature: Column | float = 1.0) -> Column:
    """Probability of class 1 from two logits at a temperature, shifted by the larger."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    a, b = l0 / t, l1 / t
    m = F.greatest(a, b)
    return F.exp(b - m) / (F.exp(a - m) + F.exp(b - m))


def hard_decision(l0: Column, l1: Column, tie_to_positive: bool = True) -> Column:
    """Argmax of two logits; ties as told."""
    return (l1 >= l0 if tie_to_positive else l1 > l0).cast("int")


def calibrated(facts: DataFrame, temperatures: DataFrame) -> DataFrame:
    """``facts`` (experiment, l0, l1) with probabilities before and after its experiment's temperature.

    ``decision_kept`` tells whether the larger class stayed the same. One row an experiment is joined.
    """
    rows = facts.join(F.broadcast(temperatures), "experiment")
    rows = rows.select("*", softmax_positive(F.col("l0"), F.col("l1")).alias("p_uncalibrated"), softmax_positive(F.col("l0"), F.col("l1"), F.col("temperature")).alias("p_calibrated"))
    return rows.withColumn("decision_kept", (F.col("p_uncalibrated") >= 0.5) == (F.col("p_calibrated") >= 0.5))


def nll_at(l0: Column, l1: Column, y: Column, temperature: Column) -> Column:
    """Negative log likelihood of a row at a temperature, by the log-sum of the exponentials."""
    gap = F.when(y == 1, l0 - l1).otherwise(l1 - l0) / temperature
    return F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))


def temperature_grid(facts: DataFrame, grid: tuple[float, ...]) -> DataFrame:
    """Mean NLL of each experiment at each temperature, one pass for all of them."""
    sums = facts.groupBy("experiment").agg(*(F.avg(nll_at(F.col("l0"), F.col("l1"), F.col("y"), F.lit(t))).alias(f"t{i}") for i, t in enumerate(grid)))
    pairs = ", ".join(f"{t!r}D, t{i}" for i, t in enumerate(grid))
    return sums.select("experiment", F.expr(f"stack({len(grid)}, {pairs}) as (temperature, nll)"))


def fit_temperature(facts: DataFrame, low: float = 0.05, high: float = 20.0, tolerance: float = 1e-10, rounds: int = 500) -> DataFrame:
    """Golden-section search on the logarithm of the temperature, for each experiment.

    Of the two bounds, the middle found and 1 the one with the least NLL wins, ties to the one nearest to 1. The search
    runs over distinct (gap, count) pairs, where gap is the logit of the wrong class above the right one, so an
    experiment is held by its distinct gaps.
    """

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for experiment, rows in frame.groupby("experiment"):
                gap, n = np.concatenate(rows["gaps"].to_list()), np.concatenate(rows["counts"].to_list()).astype(float)

                def loss(log_t: float, gap=gap, n=n) -> float:
                    g = gap / math.exp(log_t)
                    return float(np.sum(n * (np.maximum(g, 0) + np.log1p(np.exp(-np.abs(g))))) / n.sum())

                a, b = math.log(low), math.log(high)
                golden = (math.sqrt(5) - 1) / 2
                x, y = b - golden * (b - a), a + golden * (b - a)
                fx, fy = loss(x), loss(y)
                for _ in range(rounds):
                    if b - a <= tolerance:
                        break
                    if fx <= fy:
                        b, y, fy = y, x, fx
                        x = b - golden * (b - a)
                        fx = loss(x)
                    else:
                        a, x, fx = x, y, fy
                        y = a + golden * (b - a)
                        fy = loss(y)
                middle = (a + b) / 2
                best = min((0.0, math.log(low), math.log(high), middle), key=lambda t: (loss(t), abs(t)))
                yield pd.DataFrame({"experiment": [experiment], "temperature": [math.exp(best)], "nll": [loss(best)]})

    gap = F.when(F.col("y") == 1, F.col("l0") - F.col("l1")).otherwise(F.col("l1") - F.col("l0"))
    distinct = facts.where("y is not null and l0 is not null and l1 is not null").groupBy("experiment", gap.alias("gap")).agg(F.count("*").alias("n"))
    held = distinct.groupBy("experiment").agg(F.collect_list("gap").alias("gaps"), F.collect_list("n").alias("counts"))
    return held.mapInPandas(search, "experiment string, temperature double, nll double")


def _highest(value: Column, thresholds: tuple[float, ...], low: int, high: int) -> Column:
    """The index of the highest threshold that a value reaches, -1 for none, by halving the sorted thresholds."""
    if high - low == 1:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value >= thresholds[middle], _highest(value, thresholds, middle, high)).otherwise(_highest(value, thresholds, low, middle))


def risk_coverage(facts: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, epsilon: float = 0.0) -> DataFrame:
    """Coverage, risk and class coverage at each threshold of confidence (a prediction is accepted if conf + epsilon >= t).

    Rows are counted once, by the highest threshold they reach; the counts are then summed from the top.
    """
    conf = F.greatest(F.col("p"), 1 - F.col("p"))
    step = _highest(conf + epsilon, thresholds, -1, len(thresholds))
    cells = facts.where("y is not null and p is not null").groupBy("experiment", step.alias("step")).agg(
        F.count("*").alias("n"), F.count_if(F.col("y") != F.col("pred")).alias("errors"), F.sum("y").alias("pos"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 1)).alias("tp"), F.count_if((F.col("y") == 0) & (F.col("pred") == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (F.col("pred") == 0)).alias("fn"),
    )
    frame = cells.select("experiment").distinct().select("experiment", F.posexplode(F.array(*(F.lit(t) for t in thresholds))).alias("step", "threshold"))
    every = frame.unionByName(cells.select("experiment").distinct().select("experiment", F.lit(-1).alias("step"), F.lit(None).cast("double").alias("threshold")))
    full = every.join(cells, ["experiment", "step"], "left").na.fill(0, ["n", "errors", "pos", "tp", "fp", "fn"])
    above = Window.partitionBy("experiment").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("experiment")
    names = ("n", "errors", "pos", "tp", "fp", "fn")
    sums = full.select("experiment", "step", "threshold", *(F.sum(c).over(above).alias(c) for c in names), *(F.sum(c).over(whole).alias(f"all_{c}") for c in ("n", "pos", "errors")))
    n, total = F.col("n").cast("double"), F.col("all_n").cast("double")
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return sums.where("step >= 0").select(
        "experiment", "threshold", F.col("n").alias("accepted"), (F.col("all_n") - F.col("n")).alias("abstained"), F.col("errors").alias("accepted_errors"),
        ratio(n, total).alias("coverage"), ratio(F.col("errors").cast("double"), n).alias("risk"),
        ratio(F.col("pos").cast("double"), F.col("all_pos").cast("double")).alias("coverage_1"), ratio(n - F.col("pos"), total - F.col("all_pos")).alias("coverage_0"),
        ratio(tp, tp + fp).alias("accepted_precision_1"), ratio(tp, tp + fn).alias("accepted_recall_1"), ratio(tp, F.col("all_pos").cast("double")).alias("recall_1_with_abstentions"),
        f_score(ratio(tp, tp + fp, 0.0), ratio(tp, tp + fn, 0.0), 0.0).alias("accepted_f1_1"),
    )


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the 95 % Wilson interval of k of n, within 0 and 1; null for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, Z95 * Z95
    centre, half = p + z2 / (2 * n), Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low = F.when(n > 0, F.greatest(F.lit(0.0), (centre - half) / (1 + z2 / n)))
    high = F.when(n > 0, F.least(F.lit(1.0), (centre + half) / (1 + z2 / n)))
    return low, high


def policy_candidates(curve: DataFrame, fixed: tuple[float, ...] = (0.7, 0.8, 0.9), floors: tuple[float, ...] = (0.9, 0.8, 0.7)) -> DataFrame:
    """Fixed thresholds, and for each coverage floor the lowest risk with both classes accepted.

    Ties go to the higher coverage, then the lower threshold; a floor that nothing meets has no row.
    """
    kept = curve.where(F.col("threshold").isin(*fixed)).select("experiment", F.concat(F.lit("fixed_"), F.format_string("%.2f", "threshold")).alias("policy"), "threshold", "coverage", "risk")
    floored = curve.where("coverage_0 > 0 and coverage_1 > 0").withColumn("floor", F.explode(F.array(*(F.lit(f) for f in floors)))).where("coverage >= floor")
    order = Window.partitionBy("experiment", "floor").orderBy("risk", F.desc("coverage"), "threshold")
    best = floored.withColumn("k", F.row_number().over(order)).where("k = 1")
    return kept.unionByName(best.select("experiment", F.concat(F.lit("coverage_"), F.format_string("%.2f", "floor")).alias("policy"), "threshold", "coverage", "risk"))


def operating_point(facts: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Accepted and abstained rows and errors at one threshold, how far errors gather among the abstained, coverage by predicted class."""
    taken = F.greatest(F.col("p"), 1 - F.col("p")) >= threshold
    wrong = F.col("y") != F.col("pred")
    sums = facts.where("y is not null and p is not null").groupBy("experiment").agg(
        F.count("*").alias("n"), F.count_if(taken).alias("accepted"), F.count_if(taken & wrong).alias("accepted_errors"), F.count_if(~taken & wrong).alias("abstained_errors"),
        F.count_if(F.col("pred") == 1).alias("p1"), F.count_if(taken & (F.col("pred") == 1)).alias("a1"), F.count_if(F.col("pred") == 0).alias("p0"), F.count_if(taken & (F.col("pred") == 0)).alias("a0"),
    )
    d = lambda c: F.col(c).cast("double")
    low, high = wilson(F.col("accepted_errors"), F.col("accepted"))
    return sums.select(
        "experiment", "accepted", (F.col("n") - F.col("accepted")).alias("abstained"), "accepted_errors", "abstained_errors",
        ratio(d("abstained_errors"), d("accepted_errors") + d("abstained_errors")).alias("error_concentration"),
        ratio(d("a1"), d("p1")).alias("coverage_predicted_1"), ratio(d("a0"), d("p0")).alias("coverage_predicted_0"), low.alias("risk_low"), high.alias("risk_high"),
    )


def accept_status(conf: Column, threshold: float = 0.6) -> Column:
    return F.when(conf >= threshold, "accepted").otherwise("abstained")
