"""Classification, ranking and probability metrics over a fact table of predictions.

The fact table has experiment, y (0 or 1), p (probability of 1), pred (0 or 1) and, where used, soft, group_id and
example_id. Every metric is one grouped aggregate over all experiments. Ranking metrics are computed on distinct
scores, so their windows run over pre-aggregated rows, one partition an experiment. An undefined metric is null unless
said otherwise. Rows with a null y or p take no part in the metrics that need them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOW = 1e-15
DIGITS = 9


def ratio(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or ``default`` where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def f_score(precision: Column, recall: Column, default: float | None = None) -> Column:
    """The harmonic mean; null if either is, ``default`` where both are zero."""
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).when(precision.isNull() | recall.isNull(), F.lit(None).cast("double")).otherwise(F.lit(default).cast("double"))


def rounded(df: DataFrame, keys: tuple[str, ...], digits: int = DIGITS) -> DataFrame:
    """Doubles to ``digits`` places, for comparison across engines."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes))


def confusion_columns(y: Column, pred: Column) -> list[Column]:
    cell = lambda a, b, name: F.count_if((y == a) & (pred == b)).alias(name)
    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def confusion(facts: DataFrame, by: tuple[str, ...] = ("experiment",)) -> DataFrame:
    """Counts, support and predicted positives of each group."""
    cells = facts.groupBy(*by).agg(*confusion_columns(F.col("y"), F.col("pred")))
    return cells.select("*", (F.col("tn") + F.col("fp")).alias("support_0"), (F.col("fn") + F.col("tp")).alias("support_1"), (F.col("fp") + F.col("tp")).alias("predicted_1"))


def class_metrics(cells: DataFrame, nullable: bool = False) -> DataFrame:
    """Precision, recall and F1 of both classes, macro F1, accuracy and balanced accuracy from confusion counts.

    With ``nullable`` an undefined quotient is null and so is what follows from it; else it is 0.
    """
    zero = None if nullable else 0.0
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    keys = [c for c in cells.columns if c not in ("tn", "fp", "fn", "tp", "support_0", "support_1", "predicted_1")]
    base = cells.select(
        *keys,
        ratio(tp, tp + fp, zero).alias("precision_1"), ratio(tp, tp + fn, zero).alias("recall_1"),
        ratio(tn, tn + fn, zero).alias("precision_0"), ratio(tn, tn + fp, zero).alias("recall_0"),
        ratio(tn + tp, tn + fp + fn + tp, zero).alias("accuracy"),
    )
    base = base.select("*", f_score(F.col("precision_1"), F.col("recall_1"), zero).alias("f1_1"), f_score(F.col("precision_0"), F.col("recall_0"), zero).alias("f1_0"))
    return base.select("*", ((F.col("f1_0") + F.col("f1_1")) / 2).alias("macro_f1"), ((F.col("recall_0") + F.col("recall_1")) / 2).alias("balanced_accuracy"))


def _by_score(facts: DataFrame, score: str) -> DataFrame:
    return facts.where(F.col("y").isNotNull() & F.col(score).isNotNull()).groupBy("experiment", F.col(score).alias("score")).agg(F.sum("y").cast("double").alias("pos"), F.count("*").cast("double").alias("n"))


#: Parts of the range of a score, by a function that never falls: so many between 0 and 1, and as many beyond.
SCORE_PARTS = 4_096


def _part(score: Column) -> Column:
    """Scores of a higher part are greater; the part beyond all holds NaN, which sorts last."""
    x = score.cast("double")
    squeezed = F.when(F.abs(x) == float("inf"), F.signum(x)).otherwise(x / (1 + F.abs(x)))
    return F.when(F.isnan(x), 2 * SCORE_PARTS + 1).otherwise(F.floor(squeezed * (2 * SCORE_PARTS))).cast("int")


def running_sums(rows: DataFrame, score: str, names: tuple[str, ...], descending: bool = False) -> DataFrame:
    """``rows`` (experiment, ``score``, ...) with upto_<name>: the sum over the experiment's rows up to and with this one.

    Rows are summed within parts of the score's range, and the parts' sums, at most ``4 * SCORE_PARTS`` an experiment,
    are added up before them, so no task sorts a whole experiment.
    """
    placed = rows.withColumn("_part", _part(F.col(score)))
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = placed.groupBy("experiment", "_part").agg(*(F.sum(c).alias(f"_{c}") for c in names))
    earlier = Window.partitionBy("experiment").orderBy(order("_part")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("experiment", "_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0.0)).alias(f"_{c}") for c in names))
    within = Window.partitionBy("experiment", "_part").orderBy(order(score)).rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("*", *(F.sum(c).over(within).alias(f"upto_{c}") for c in names)).join(totals, ["experiment", "_part"])
    return summed.select(*rows.columns, *((F.col(f"upto_{c}") + F.col(f"_{c}")).alias(f"upto_{c}") for c in names))


def roc_auc(facts: DataFrame, score: str = "p") -> DataFrame:
    """Area under the ROC curve by average ranks (Mann-Whitney); null with one class only."""
    ranked = running_sums(_by_score(facts, score).withColumn("neg", F.col("n") - F.col("pos")), "score", ("neg",))
    won = F.col("pos") * (F.col("upto_neg") - F.col("neg") / 2)
    sums = ranked.groupBy("experiment").agg(F.sum(won).alias("won"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return sums.select("experiment", ratio(F.col("won"), F.col("p") * (F.col("n") - F.col("p"))).alias("roc_auc"))


def average_precision(facts: DataFrame, score: str = "p") -> DataFrame:
    """Average precision, tied scores taken together; null without positives."""
    ranked = running_sums(_by_score(facts, score), "score", ("pos", "n"), descending=True)
    sums = ranked.groupBy("experiment").agg(F.sum(F.col("pos") * F.col("upto_pos") / F.col("upto_n")).alias("s"), F.sum("pos").alias("p"))
    return sums.select("experiment", ratio(F.col("s"), F.col("p")).alias("average_precision"))


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(LOW)), F.lit(1 - LOW))


def nll(y: Column, p: Column) -> Column:
    q = clipped(p)
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


def ten_bins(p: Column) -> Column:
    """The equal-width bin of a probability by comparison with its edges; 1.0 falls into the last."""
    at = F.lit(0)
    for k in range(1, 10):
        at = F.when(p >= F.lit(k / 10), k).otherwise(at)
    return at


def probability_metrics(facts: DataFrame) -> DataFrame:
    """NLL, Brier score, ECE over ten bins, calibration in the large, mean probability, prevalence, and the soft-label losses."""
    y, p, soft = F.col("y").cast("double"), F.col("p"), F.col("soft")
    q = clipped(p)
    known = facts.where("y is not null and p is not null")
    parts = known.groupBy("experiment", ten_bins(p).alias("bin")).agg(
        F.count("*").cast("double").alias("n"), F.sum(y).alias("y"), F.sum(p).alias("p"), F.sum(nll(y, p)).alias("nll"), F.sum((p - y) * (p - y)).alias("brier"),
        F.sum(-(soft * F.log(q) + (1 - soft) * F.log(1 - q))).alias("soft_ce"), F.sum((p - soft) * (p - soft)).alias("soft_brier"), F.sum(F.abs(p - soft)).alias("soft_mad"),
    )
    n = F.sum("n")
    mean = lambda c: (F.sum(c) / n).alias(c)
    return parts.groupBy("experiment").agg(
        n.cast("long").alias("n"), mean("nll"), mean("brier"), (F.sum(F.abs(F.col("p") - F.col("y"))) / n).alias("ece"), ((F.sum("p") - F.sum("y")) / n).alias("calibration_in_the_large"),
        (F.sum("p") / n).alias("mean_probability"), (F.sum("y") / n).alias("prevalence"), mean("soft_ce"), mean("soft_brier"), mean("soft_mad"),
    )


def reliability(facts: DataFrame) -> DataFrame:
    """Ten bins of each experiment: rows, mean confidence, observed rate and gap; empty bins have nulls."""
    parts = facts.where("y is not null and p is not null").groupBy("experiment", ten_bins(F.col("p")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))
    frame = parts.select("experiment").distinct().select("experiment", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bin"))
    full = frame.join(parts, ["experiment", "bin"], "left")
    return full.select("experiment", "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", F.abs(F.col("mean_p") - F.col("rate")).alias("gap"))


def skill(facts: DataFrame, base_rate: float | None = None) -> DataFrame:
    """Brier skill and NLL gain over a constant probability, by default each experiment's prevalence."""
    y, p = F.col("y").cast("double"), F.col("p")
    sums = facts.where("y is not null and p is not null").groupBy("experiment").agg(F.count("*").cast("double").alias("n"), F.sum(y).alias("pos"), F.sum((p - y) * (p - y)).alias("brier"), F.sum(nll(y, p)).alias("nll"))
    b = F.lit(base_rate).cast("double") if base_rate is not None else F.col("pos") / F.col("n")
    q = clipped(b)
    null_brier = (F.col("pos") * (1 - b) * (1 - b) + (F.col("n") - F.col("pos")) * b * b) / F.col("n")
    null_nll = -(F.col("pos") * F.log(q) + (F.col("n") - F.col("pos")) * F.log(1 - q)) / F.col("n")
    return sums.select("experiment", b.alias("base_rate"), null_brier.alias("null_brier"), null_nll.alias("null_nll"), (1 - ratio(F.col("brier") / F.col("n"), null_brier)).alias("brier_skill"), (null_nll - F.col("nll") / F.col("n")).alias("nll_gain"))


def average_ranks(facts: DataFrame, column: str) -> DataFrame:
    """experiment, value and average rank of each distinct value of a column."""
    counts = facts.groupBy("experiment", F.col(column).alias("value")).agg(F.count("*").cast("double").alias("n"))
    return running_sums(counts, "value", ("n",)).select("experiment", "value", (F.col("upto_n") - (F.col("n") - 1) / 2).alias("rank"))


def spearman(facts: DataFrame, a: str = "p", b: str = "soft") -> DataFrame:
    """Spearman's correlation by average ranks; null for fewer than two rows or a constant column."""
    known = facts.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = known.groupBy("experiment", F.col(a).alias("va"), F.col(b).alias("vb")).agg(F.count("*").cast("double").alias("n"))
    ra = average_ranks(known, a).select("experiment", F.col("value").alias("va"), F.col("rank").alias("ra"))
    rb = average_ranks(known, b).select("experiment", F.col("value").alias("vb"), F.col("rank").alias("rb"))
    ranked = cells.join(ra, ["experiment", "va"]).join(rb, ["experiment", "vb"])
    s = lambda c: F.sum(F.col("n") * c)
    x, y = F.col("ra"), F.col("rb")
    sums = ranked.groupBy("experiment").agg(F.sum("n").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(x * y).alias("sxy"), s(x * x).alias("sxx"), s(y * y).alias("syy"))
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return sums.select("experiment", n.cast("long").alias("n"), F.when((n >= 2) & (vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx) / F.sqrt(vy)).alias("spearman"))


def slice_metrics(facts: DataFrame, slices: list[tuple[str, Column]]) -> DataFrame:
    """Confusion counts and null-propagating metrics of each named slice, in one pass over the facts."""
    labelled = facts.select("experiment", "y", "pred", F.explode(F.array(*(F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit("null"))) for name, value in slices))).alias("slice"))
    cells = confusion(labelled, ("experiment", "slice"))
    metrics = class_metrics(cells, nullable=True)
    return cells.select("experiment", "slice", "tn", "fp", "fn", "tp").join(metrics.select("experiment", "slice", "macro_f1", "f1_1", "recall_1", "accuracy"), ["experiment", "slice"])


def model_agreement(facts: DataFrame) -> DataFrame:
    """Share of examples that two experiments predict alike, for each pair.

    Predictions of one example are gathered first, one for each experiment, so the pairs are made row by row.
    """
    per = facts.groupBy("example_id").agg(F.sort_array(F.collect_set(F.struct("experiment", "pred"))).alias("preds"))
    left = per.select(F.explode("preds").alias("a"), "preds").select("a", F.explode("preds").alias("b"))
    pairs = left.where("a.experiment < b.experiment").groupBy(F.col("a.experiment").alias("left_experiment"), F.col("b.experiment").alias("right_experiment"))
    return pairs.agg(F.count("*").alias("n"), F.count_if(F.expr("a.pred = b.pred")).alias("n_same"), F.avg(F.expr("double(if(a.pred = b.pred, 1, 0))")).alias("agreement"))


def unpivoted(metrics: DataFrame, key: str = "experiment") -> DataFrame:
    """One row a metric."""
    names = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.unpivot([key], names, "metric", "value")


def compared(metrics: DataFrame, pairs: list[tuple[str, str]], key: str = "experiment") -> DataFrame:
    """Left minus right of every metric for each pair of experiments; null if either is."""
    long = unpivoted(metrics, key)
    wanted = F.broadcast(metrics.sparkSession.createDataFrame(pairs, "left_experiment string, right_experiment string"))
    left = long.select(F.col(key).alias("left_experiment"), "metric", F.col("value").alias("left_value"))
    right = long.select(F.col(key).alias("right_experiment"), "metric", F.col("value").alias("right_value"))
    joined = left.join(wanted, "left_experiment").join(right, ["right_experiment", "metric"])
    return joined.select("left_experiment", "right_experiment", "metric", "left_value", "right_value", (F.col("left_value") - F.col("right_value")).alias("difference"))


def verdicts(differences: DataFrame) -> DataFrame:
    """favourable if every difference is above zero, unfavourable if every one is below, else mixed."""
    return differences.groupBy("left_experiment", "right_experiment").agg(F.when(F.every(F.col("difference") > 0), "favourable").when(F.every(F.col("difference") < 0), "unfavourable").otherwise("mixed").alias("verdict"))


def seed_summary(values: DataFrame) -> DataFrame:
    """Mean, sample deviation, least and greatest value of each experiment's metric over its seeds."""
    return values.groupBy("experiment", "metric").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("least"), F.max("value").alias("most"))


def paired_seed_differences(values: DataFrame, left: str, right: str) -> DataFrame:
    """Left minus right by seed and metric."""
    a = values.where(F.col("experiment") == left).select("seed", "metric", F.col("value").alias("a"))
    b = values.where(F.col("experiment") == right).select("seed", "metric", F.col("value").alias("b"))
    return a.join(b, ["seed", "metric"]).select("seed", "metric", (F.col("a") - F.col("b")).alias("difference"))
