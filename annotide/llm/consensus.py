"""Consensus from several annotators: a mean-field variational confusion model.

Class shares and each annotator's rows of the confusion matrix have Dirichlet priors. The posterior of an item's label
follows from the expected logarithms of both; their Dirichlet parameters follow from grouped sums of those posteriors.
Both steps are group-bys; the digamma function is a column expression.

Items with the same votes from the same annotators have the same posterior, so the rounds run over distinct vote
patterns with their numbers of items. The parameters of a round, one row an annotator and label, are written to the
shared folder. They are broadcast up to ``MOST_ANNOTATORS``; beyond it they are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annotide.functions.text import strip
from annotide.storage import Scratch

LABELS = (-1, 0, 1)
MOST_ANNOTATORS = 20_000
_K = range(len(LABELS))


def digamma(x: Column) -> Column:
    """For x > 0: the recurrence up to x + 8, then the asymptotic series."""
    y = x + F.lit(8.0)
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * F.pow(y, F.lit(4.0))) - 1 / (252 * F.pow(y, F.lit(6.0)))
    for k in range(8):
        series = series - 1 / (x + float(k))
    return series


def valid_votes(votes: DataFrame, vote: str = "vote_id", item: str = "example_id", annotator: str = "annotator_id", label: str = "label") -> DataFrame:
    """item, annotator, label (INT), n: each vote_id once; null or empty ids and labels, and labels outside the domain, do not count.

    Of rows that contradict each other under one vote_id the smallest in the order item, annotator, label counts. A
    vote whose vote_id is null is told apart by its other columns.
    """
    clean = votes.select(F.col(vote).alias("vote"), F.nullif(strip(item), F.lit("")).alias("item"), F.nullif(strip(annotator), F.lit("")).alias("annotator"), strip(label).alias("label"))
    clean = clean.where(F.col("label").isin(*map(str, LABELS))).dropna(subset=["item", "annotator"]).withColumn("label", F.col("label").cast("int"))
    once = clean.where("vote is not null").groupBy("vote").agg(F.min(F.struct("item", "annotator", "label")).alias("s")).select("s.*")
    once = once.union(clean.where("vote is null").select("item", "annotator", "label").distinct())
    return once.groupBy("item", "annotator", "label").agg(F.count("*").alias("n"))


def vote_patterns(votes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(item, pattern) and (pattern, items, votes m, annotator, label, n). A pattern is one of the sets of votes that items got."""
    cells = votes.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("annotator", "label", "n"))).alias("cells"))  # at most labels x annotators
    items = scratch.write(cells.select("item", F.xxhash64("cells").alias("p1"), F.xxhash64(F.lit(1), "cells").alias("p2"), "cells"), "items")
    distinct = items.groupBy("p1", "p2").agg(F.first("cells").alias("cells"), F.count("*").alias("items"))
    m = F.aggregate(F.transform("cells", lambda c: c["n"]), F.lit(0).cast("long"), lambda s, n: s + n)
    rows = scratch.write(distinct.select("p1", "p2", "items", m.alias("m"), F.inline("cells")), "patterns")
    return items.select("item", "p1", "p2"), rows


def _posteriors(rows: DataFrame, params: DataFrame, classes: list[float], few: bool) -> DataFrame:
    """``rows`` with r0, r1, r2: the posterior of the pattern's label."""
    joined = rows.join(F.broadcast(params) if few else params, ["annotator", "label"])
    within = Window.partitionBy("p1", "p2")
    scores = joined.select(*rows.columns, *((F.sum(F.col("n") * F.col(f"e{k}")).over(within) + F.lit(classes[k])).alias(f"s{k}") for k in _K))
    top = F.greatest(*(F.col(f"s{k}") for k in _K))
    total = sum(F.exp(F.col(f"s{k}") - top) for k in _K)
    return scores.select(*rows.columns, *((F.exp(F.col(f"s{k}") - top) / total).alias(f"r{k}") for k in _K))


def _update(voted: DataFrame, prior: float, diagonal: float) -> DataFrame:
    """Dirichlet parameters a_k of each annotator and label, for true labels k, and their expected logarithms e_k."""
    mass = F.col("n") * F.col("items")
    counts = voted.groupBy("annotator", "label").agg(
        *(F.sum(mass * F.col(f"r{k}")).alias(f"c{k}") for k in _K),
        *(F.sum(mass / F.col("m") * F.col(f"r{k}")).alias(f"g{k}") for k in _K),  # each vote carries its part of the item
    )
    domain = voted.select("annotator").distinct().select("annotator", F.explode(F.array(*(F.lit(x) for x in LABELS))).alias("label"))
    full = domain.join(counts, ["annotator", "label"], "left")
    own = [F.when(F.col("label") == LABELS[k], prior + diagonal).otherwise(prior) for k in _K]
    full = full.select("annotator", "label", *((F.coalesce(f"c{k}", F.lit(0.0)) + own[k]).alias(f"a{k}") for k in _K), *(F.coalesce(f"g{k}", F.lit(0.0)).alias(f"g{k}") for k in _K))
    rows = Window.partitionBy("annotator")
    full = full.select("*", *(F.sum(f"a{k}").over(rows).alias(f"t{k}") for k in _K))
    return full.select("*", *((digamma(F.col(f"a{k}")) - digamma(F.col(f"t{k}"))).alias(f"e{k}") for k in _K))


def fit(rows: DataFrame, scratch: Scratch, rounds: int = 60, tolerance: float = 1e-4, prior: float = 1.0, diagonal: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Runs the model over vote patterns: posteriors (p1, p2, items, r0 to r2) and annotators' parameters.

    It starts from the share of each label among a pattern's votes and ends when no expected entry of a confusion
    matrix moves by more than ``tolerance``, or after ``rounds``.
    """
    within = Window.partitionBy("p1", "p2")
    counted = rows.select("*", *(F.sum(F.when(F.col("label") == LABELS[k], F.col("n")).otherwise(0)).over(within).alias(f"m{k}") for k in _K))
    voted = counted.select(*rows.columns, *(((F.col(f"m{k}") + 0.5) / (F.col("m") + 1.5)).alias(f"r{k}") for k in _K))
    few, before, params, classes = True, None, None, [0.0, 0.0, 0.0]
    for i in range(rounds):
        if params is not None:
            voted = _posteriors(rows, params, classes, few)
        step = _update(voted, prior, diagonal)
        if before is not None:
            old = before.select("annotator", "label", *((F.col(f"a{k}") / F.col(f"t{k}")).alias(f"old{k}") for k in _K))
            moved = F.greatest(*(F.abs(F.col(f"a{k}") / F.col(f"t{k}") - F.col(f"old{k}")) for k in _K))
            step = step.join(old, ["annotator", "label"]).withColumn("moved", moved)
        else:
            step = step.withColumn("moved", F.lit(1.0))
        params = scratch.write(step, f"round-{i}")
        seen = params.agg(F.max("moved").alias("moved"), F.countDistinct("annotator").alias("n"), *(F.sum(f"g{k}").alias(f"g{k}") for k in _K)).first()
        if seen["n"] == 0:
            break
        few = seen["n"] <= MOST_ANNOTATORS
        mass = [seen[f"g{k}"] + prior for k in _K]
        classes = [_digamma(m) - _digamma(sum(mass)) for m in mass]
        if seen["moved"] < tolerance:
            break
        if before is not None:
            scratch.drop(f"round-{i - 1}")
        before = params
    if params is None:
        raise ValueError("rounds must be at least 1")
    final = _posteriors(rows, params, classes, few)
    return final.select("p1", "p2", "items", *(f"r{k}" for k in _K)).dropDuplicates(["p1", "p2"]), params


def _digamma(x: float) -> float:
    import math

    total = 0.0
    while x < 8:
        total -= 1 / x
        x += 1
    return total + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)


def consensus(votes: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(labels, parameters) of the valid votes. labels: item, consensus_label, credibility, n_votes, top_votes, agreement.

    agreement is the share of pairs of votes that agree (null for one vote). Ties go to the smaller label. An item
    without valid votes is in no row; tables without votes give none.
    """
    scratch = scratch or Scratch(votes.sparkSession, "consensus")
    items, rows = vote_patterns(votes, scratch)
    posteriors, params = fit(rows, scratch)
    tallies = rows.groupBy("p1", "p2").agg(*(F.sum(F.when(F.col("label") == LABELS[k], F.col("n")).otherwise(0)).alias(f"n{k}") for k in _K))
    best = F.greatest(*(F.col(f"r{k}") for k in _K))
    label = F.when(F.col("r0") == best, LABELS[0]).when(F.col("r1") == best, LABELS[1]).otherwise(LABELS[2])
    total = F.col("n0") + F.col("n1") + F.col("n2")
    same = sum(F.col(f"n{k}") * (F.col(f"n{k}") - 1) for k in _K)
    most = F.greatest("n0", "n1", "n2")
    plural = F.when(F.col("n0") == most, LABELS[0]).when(F.col("n1") == most, LABELS[1]).otherwise(LABELS[2])
    settled = scratch.write(
        posteriors.join(tallies, ["p1", "p2"]).select(
            "p1", "p2", label.cast("long").alias("consensus_label"), best.alias("credibility"), total.alias("n_votes"), most.alias("top_votes"), plural.cast("long").alias("plurality_label"),
            F.when(total > 1, same / (total * (total - 1))).alias("agreement"),
        ),
        "settled",
    )
    return items.join(settled, ["p1", "p2"]).drop("p1", "p2"), params


def annotator_reliability(params: DataFrame) -> DataFrame:
    """annotator, reliability (chance to name the true label, by class shares) and its 95 % interval."""
    diagonal = params.select("annotator", "label", *(F.when(F.col("label") == LABELS[k], F.col(f"a{k}")).alias(f"d{k}") for k in _K), *(f"t{k}" for k in _K))
    per = diagonal.groupBy("annotator").agg(*(F.max(f"d{k}").alias(f"d{k}") for k in _K), *(F.max(f"t{k}").alias(f"t{k}") for k in _K))
    totals = params.agg(*(F.sum(f"g{k}").alias(f"g{k}") for k in _K)).first()
    mass = [totals[f"g{k}"] or 0.0 for k in _K]
    weight = [F.lit(m / (sum(mass) or 1.0)) for m in mass]
    mean = sum(weight[k] * F.col(f"d{k}") / F.col(f"t{k}") for k in _K)
    variance = sum(weight[k] * weight[k] * F.col(f"d{k}") * (F.col(f"t{k}") - F.col(f"d{k}")) / (F.col(f"t{k}") * F.col(f"t{k}") * (F.col(f"t{k}") + 1)) for k in _K)
    # Fixed value: the normal quantile of a two-sided 95 % interval.
    half = 1.959963984540054 * F.sqrt(variance)
    return per.select("annotator", F.round(mean, 6).alias("reliability"), F.round(F.greatest(F.lit(0.0), mean - half), 6).alias("low"), F.round(F.least(F.lit(1.0), mean + half), 6).alias("high"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """One row: units with two or more votes, their votes, and Krippendorff's nominal alpha (null if no two labels occur)."""
    cells = votes.groupBy("item").agg(*(F.sum(F.when(F.col("label") == LABELS[k], F.col("n")).otherwise(0)).alias(f"n{k}") for k in _K))
    m = F.col("n0") + F.col("n1") + F.col("n2")
    apart = (m * m - sum(F.col(f"n{k}") * F.col(f"n{k}") for k in _K)) / (m - 1)
    sums = cells.where(m > 1).agg(F.count("*").alias("units"), F.sum(m).alias("votes"), F.sum(apart).alias("observed"), *(F.sum(f"n{k}").alias(f"s{k}") for k in _K))
    n = F.col("votes")
    expected = (n * n - sum(F.col(f"s{k}") * F.col(f"s{k}") for k in _K)) / (n - 1)
    alpha = F.when(expected > 0, 1 - F.col("observed") / expected)
    return sums.select("units", F.coalesce("votes", F.lit(0)).alias("votes"), F.round(alpha, 6).alias("alpha"))
