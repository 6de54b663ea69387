"""Allocation of whole groups to partitions under balance constraints, with diagnostics and checks."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARES = {"train": 0.70, "dev_tune": 0.075, "dev_calibration": 0.075, "test": 0.15}
OUTER = {"train": "train", "dev_tune": "development", "dev_calibration": "development", "test": "test"}
# Seed and stride of the multi-start search.
SEED, STRIDE, CANDIDATES = 42, 1_000_003, 256
#: Groups that the search places one by one, at most: the largest. The rest follows by hash into what is left to fill.
LARGEST = 50_000
KINDS = ("examples", "positive", "other")
# How far a partition's share of the examples and its rate of positives may be off.
EXAMPLE_TOLERANCE, RATE_TOLERANCE = 0.02, 0.03
BUCKETS = 1 << 20


def group_records(members: DataFrame, labels: DataFrame) -> DataFrame:
    """group_id, examples, positive, other over (example_id, group_id) and (example_id, hard_label)."""
    joined = members.select("example_id", "group_id").join(labels.select("example_id", "hard_label").dropDuplicates(["example_id"]), "example_id")
    return joined.groupBy("group_id").agg(F.count("*").alias("examples"), F.count_if(F.col("hard_label") == 1).alias("positive"), F.count_if(F.col("hard_label") == 0).alias("other"))


def share_of(partition: Column, shares: dict[str, float] | None = None) -> Column:
    value = F.lit(None).cast("double")
    for name, share in (shares or SHARES).items():
        value = F.when(partition == name, F.lit(share)).otherwise(value)
    return value


def diagnostics(assigned: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Per partition: groups, counts, targets and deviations, over (group_id, partition, examples, positive, other).

    Totals are taken from the partitions' own sums, so nothing is shuffled twice.
    """
    from pyspark.sql.window import Window

    per = assigned.groupBy("partition").agg(F.count("*").alias("groups"), *(F.sum(k).alias(k) for k in KINDS))
    whole = Window.partitionBy(F.lit(1))  # a row a partition
    share = share_of(F.col("partition"), shares)
    return per.select("*", *((F.sum(k).over(whole) * share).alias(f"target_{k}") for k in KINDS)).select("*", *((F.col(k) - F.col(f"target_{k}")).alias(f"deviation_{k}") for k in KINDS))


def objective(diagnosed: DataFrame) -> DataFrame:
    """Sum over partitions and kinds of (count - target)^2 / max(target, 1)."""
    part = lambda k: F.pow(F.col(f"deviation_{k}"), F.lit(2.0)) / F.greatest(F.col(f"target_{k}"), F.lit(1.0))
    return diagnosed.agg(F.sum(part("examples") + part("positive") + part("other")).alias("objective"))


def balance_checks(diagnosed: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """check, passed: each partition's share of the examples and its rate of positives within tolerance, and both classes in it."""
    from pyspark.sql.window import Window

    whole = Window.partitionBy(F.lit(1))  # a row a partition
    rate = F.sum("positive").over(whole) / F.sum("examples").over(whole)
    near = F.abs(F.col("examples") / F.sum("examples").over(whole) - share_of(F.col("partition"), shares)) <= EXAMPLE_TOLERANCE + 1e-12
    level = F.abs(F.col("positive") / F.col("examples") - rate) <= RATE_TOLERANCE + 1e-12
    both = (F.col("positive") > 0) & (F.col("other") > 0)
    named = lambda kind, passed: F.struct(F.concat("partition", F.lit(f"_{kind}")).alias("check"), passed.alias("passed")).alias(kind)
    rows = diagnosed.select(named("fraction", near), named("rate", level), named("classes", both))
    return rows.select(F.inline(F.array("fraction", "rate", "classes")))


def _candidate(groups: list[tuple[str, int, int, int]], totals: tuple[int, int, int], seed: int, shares: dict[str, float]) -> tuple[list[list[int]], list[str]]:
    """Greedy placement of groups, largest first and ties by a random key: (counts by partition, partitions by the order of ``groups``)."""
    source = random.Random(seed)
    keys = {g[0]: source.random() for g in sorted(groups)}
    names = list(shares)
    wanted = [[t * shares[n] for t in totals] for n in names]
    scale = [[max(x, 1.0) for x in row] for row in wanted]
    have = [[0, 0, 0] for _ in names]
    cost = [[w * w / s for w, s in zip(wr, sr, strict=True)] for wr, sr in zip(wanted, scale, strict=True)]
    place = {}
    for group in sorted(groups, key=lambda g: (-g[1], keys[g[0]], g[0])):
        best = None
        for p in range(len(names)):
            change = 0.0
            for k in range(3):
                d = have[p][k] + group[k + 1] - wanted[p][k]
                change += d * d / scale[p][k] - cost[p][k]
            rank = (change, have[p][0] / scale[p][0], p)
            if best is None or rank < best:
                best = rank
        p = best[2]
        for k in range(3):
            have[p][k] += group[k + 1]
            d = have[p][k] - wanted[p][k]
            cost[p][k] = d * d / scale[p][k]
        place[group[0]] = names[p]
    return have, [place[g[0]] for g in groups]


def evaluation(counts: list[list[int]], totals: tuple[int, int, int], shares: dict[str, float]) -> tuple[int, float, float]:
    """(infeasible, violation, objective) of a split by its counts of ``KINDS`` in each partition: the less the better.

    The violation sums what the shares of the examples and the rates of positives exceed their tolerances by, and 1 for
    each partition that lacks a class.
    """
    feasible, violation, costs = True, 0.0, []
    for (examples, positive, other), share in zip(counts, shares.values(), strict=True):
        fraction = examples / totals[0] if totals[0] else 0.0
        rate = positive / examples if examples else 0.0
        over = max(0.0, abs(fraction - share) - EXAMPLE_TOLERANCE)
        rate_over = max(0.0, abs(rate - (totals[1] / totals[0] if totals[0] else 0.0)) - RATE_TOLERANCE)
        both = positive > 0 and other > 0
        violation += over + rate_over + (0.0 if both else 1.0)
        feasible &= over == 0 and rate_over == 0 and both
        costs += [(n - t * share) ** 2 / max(t * share, 1.0) for n, t in zip((examples, positive, other), totals, strict=True)]
    return int(not feasible), violation, sum(costs)


def _upto(filled: list[int], examples: int, shares: dict[str, float]) -> list[float]:
    """Where each partition's range of the hash of the smaller groups ends, by the shares still open."""
    open_ = [max(0.0, examples * s - n) for s, n in zip(shares.values(), filled, strict=True)]
    whole = sum(open_) or 1.0
    ends, upto = [], 1.0
    for n in reversed(open_):
        ends.append(upto)
        upto -= n / whole
    return ends[::-1]


def _with_rest(counts: list[list[int]], rest: np.ndarray | None, examples: int, shares: dict[str, float]) -> list[list[int]]:
    """``counts`` with those of the groups placed by hash; ``rest`` has the running sums of ``KINDS`` over the buckets."""
    if rest is None:
        return counts
    u = (np.arange(BUCKETS) + 0.5) / BUCKETS
    out, before = [], np.zeros(3, np.int64)
    ends = _upto([c[0] for c in counts], examples, shares)
    for p, row in enumerate(counts):
        upto = rest[BUCKETS if p == len(counts) - 1 else int(np.searchsorted(u, ends[p]))]
        upto = np.maximum(upto, before)
        out.append([n + int(x) for n, x in zip(row, upto - before, strict=True)])
        before = upto
    return out


def allocate(groups: DataFrame, shares: dict[str, float] | None = None, candidates: int = CANDIDATES, seed: int = SEED, largest: int = LARGEST) -> DataFrame:
    """group_id, examples, positive, other, partition: the best of many greedy placements.

    Candidates are searched in parallel; each places the ``largest`` groups one by one. Groups beyond those, the
    smallest, go by a hash of their id into the shares that the candidate left open. The best whole split wins by
    (infeasible, violation, objective, signature), where the signature is the list of the groups' partitions.
    """
    shares = shares or SHARES
    spark = groups.sparkSession
    totals = groups.agg(*(F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in KINDS), F.count("*").alias("groups")).first()
    total = tuple(int(totals[k]) for k in KINDS)
    head = [tuple(r) for r in groups.select("group_id", *KINDS).orderBy(F.desc("examples"), "group_id").limit(largest).collect()]  # bounded by ``largest``
    bucket = F.pmod(F.xxhash64("group_id"), F.lit(BUCKETS))
    rest = None
    if totals["groups"] > len(head):
        small = groups.join(spark.createDataFrame([(g[0],) for g in head], "group_id string"), "group_id", "left_anti")
        sums = small.groupBy(bucket.alias("bucket")).agg(*(F.sum(k).alias(k) for k in KINDS)).toPandas()  # bounded by BUCKETS
        rest = np.zeros((BUCKETS + 1, 3), np.int64)
        rest[sums["bucket"].to_numpy(np.int64) + 1] = sums[list(KINDS)].to_numpy(np.int64)
        rest = rest.cumsum(axis=0)
    shared = spark.sparkContext.broadcast((head, rest))
    order = sorted(range(len(head)), key=lambda i: head[i][0])

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups, rest = shared.value
        best = None
        for frame in frames:
            for i in frame["id"]:
                counts, places = _candidate(groups, total, seed + int(i) * STRIDE, shares)
                worth = evaluation(_with_rest(counts, rest, total[0], shares), total, shares)
                if best is None or worth <= best[0]:
                    rank = (worth, "|".join(f"{groups[j][0]}:{places[j]}" for j in order), int(i))
                    best = rank if best is None else min(best, rank)
        if best:  # one row a task
            (infeasible, violation, value), signature, i = best
            yield pd.DataFrame({"candidate": [i], "infeasible": [infeasible], "violation": [violation], "objective": [value], "signature": [signature]})

    if not head:
        return groups.withColumn("partition", F.lit(None).cast("string"))
    tried = spark.range(candidates).repartition(min(candidates, spark.sparkContext.defaultParallelism)).mapInPandas(search, "candidate long, infeasible int, violation double, objective double, signature string")
    best = tried.agg(F.min_by("candidate", F.struct("infeasible", "violation", "objective", "signature", "candidate"))).first()[0]
    counts, places = _candidate(head, total, seed + int(best) * STRIDE, shares)
    placed = spark.createDataFrame([(g[0], p) for g, p in zip(head, places, strict=True)], "group_id string, placed string")
    u = (bucket + 0.5) / BUCKETS
    by_hash = F.lit(list(shares)[-1])
    for p, upto in reversed(list(zip(shares, _upto([c[0] for c in counts], total[0], shares), strict=True))):
        by_hash = F.when(u < upto, F.lit(p)).otherwise(by_hash)
    return groups.join(placed, "group_id", "left").select("group_id", *KINDS, F.coalesce("placed", by_hash).alias("partition"))


def manifest(members: DataFrame, assigned: DataFrame) -> DataFrame:
    """example_id, group_id, outer_split, partition of every member."""
    outer = F.create_map(*(F.lit(x) for pair in OUTER.items() for x in pair))
    return members.join(assigned.select("group_id", "partition"), "group_id").select("example_id", "group_id", outer[F.col("partition")].alias("outer_split"), "partition")
