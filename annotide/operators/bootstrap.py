"""Paired cluster bootstrap on sufficient statistics of groups."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators.metrics import class_metrics, confusion_columns, nll
from annotide.storage import Scratch

REPLICATES, SEED = 5_000, 20_261_006
CELLS = ("tn", "fp", "fn", "tp")


def group_statistics(facts: DataFrame) -> DataFrame:
    """experiment, group_id, confusion counts, n, and sums of NLL and Brier: all that a replicate needs."""
    y, p = F.col("y").cast("double"), F.col("p")
    known = facts.where("y is not null and p is not null and group_id is not null")
    return known.groupBy("experiment", "group_id").agg(*confusion_columns(F.col("y"), F.col("pred")), F.count("*").alias("n"), F.sum(nll(y, p)).alias("nll"), F.sum((p - y) * (p - y)).alias("brier"))


def clusters_match(stats: DataFrame) -> DataFrame:
    """Groups that not every experiment has; a paired bootstrap needs none."""
    n = stats.select("experiment").distinct().count()
    return stats.groupBy("group_id").agg(F.count("*").alias("k")).where(F.col("k") < n).select("group_id")


def drawn(n_groups: int, replicates: int = REPLICATES, seed: int = SEED) -> Iterator[list[int]]:
    """Indices of each replicate from one Mersenne Twister stream."""
    source = random.Random(seed)
    for _ in range(replicates):
        yield [source.randrange(n_groups) for _ in range(n_groups)]


def stream_hash(n_groups: int, replicates: int = REPLICATES, seed: int = SEED) -> str:
    """A digest of all indices in order, as proof of the draw."""
    digest = hashlib.sha256()
    for indices in drawn(n_groups, replicates, seed):
        digest.update(",".join(map(str, indices)).encode() + b"\n")
    return digest.hexdigest()


#: Groups whose counts make one row of a replicate, blocks of replicates that tasks draw, and words generated at a time.
CHUNK, BLOCKS, WORDS = 2_048, 128, 1 << 20


def _words(state: tuple, n_groups: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """(state before, indices) of so many words of the stream at a time: ``random.randrange``'s, which rejects words too large."""
    if n_groups >= 1 << 32:
        raise ValueError("an index takes more than one word of the stream")
    source = np.random.MT19937()
    shift = np.uint64(32 - n_groups.bit_length())
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[0], np.uint32), "pos": state[1]}}
    while True:
        at = source.state["state"]
        words = source.random_raw(WORDS) >> shift
        yield (at["key"].tolist(), int(at["pos"])), words[words < n_groups].astype(np.int64)


def _starts(n_groups: int, replicates: int, seed: int) -> list[tuple[int, int, list[int], int, int]]:
    """first, after, key, pos, skip of every block of replicates: where in the stream it begins.

    The stream cannot be entered elsewhere, so it is generated once here, in constant memory; tasks generate their
    blocks again and count.
    """
    key = random.Random(seed).getstate()[1]
    size = -(-replicates // BLOCKS)
    bounds = list(range(0, replicates, size))
    out, seen = [], 0
    for state, indices in _words((list(key[:-1]), key[-1]), n_groups):
        while len(out) < len(bounds) and bounds[len(out)] * n_groups < seen + len(indices):
            first = bounds[len(out)]
            out.append((first, min(first + size, replicates), *state, first * n_groups - seen))
        if len(out) == len(bounds):
            return out
        seen += len(indices)
    return out


def numbered_groups(stats: DataFrame) -> tuple[DataFrame, int]:
    """group_id and its place ``at`` in their order, with their number; nothing but a count a task reaches the driver."""
    scratch = Scratch(stats.sparkSession, "bootstrap-groups")
    ids = scratch.write(stats.select("group_id").distinct().orderBy("group_id").select("group_id", F.monotonically_increasing_id().alias("m")), "ids")
    part = F.shiftright("m", 33)
    counts = sorted((r["part"], r["n"]) for r in ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, n = [], 0
    for k, c in counts:
        before.append((k, n))
        n += c
    offsets = stats.sparkSession.createDataFrame(before, "part long, before long")
    return ids.withColumn("part", part).join(F.broadcast(offsets), "part").select("group_id", (F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))).alias("at")), n


def twister_counts(spark: SparkSession, n_groups: int, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """replicate, chunk, times (little-endian counts of ``CHUNK`` neighbouring groups): all draws of one stream, made in tasks."""
    kind = _count_type(n_groups)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, after, key, pos, skip in frame[["first", "after", "key", "pos", "skip"]].itertuples(index=False):
                stream = _words((key, int(pos)), n_groups)
                indices = next(stream)[1][skip:]
                for replicate in range(first, after):
                    times, missing = np.zeros(n_groups, np.int64), n_groups
                    while missing:
                        if not len(indices):
                            indices = next(stream)[1]
                        now = indices[:missing]
                        times += np.bincount(now, minlength=n_groups)
                        indices, missing = indices[len(now) :], missing - len(now)
                    times = times.astype(kind)
                    parts = [times[i : i + CHUNK].tobytes() for i in range(0, n_groups, CHUNK)]
                    yield pd.DataFrame({"replicate": replicate, "chunk": range(len(parts)), "times": parts})

    schema = "first long, after long, key array<long>, pos long, skip long"
    starts = _starts(n_groups, replicates, seed) if n_groups and replicates else []
    blocks = spark.createDataFrame(starts, schema).repartition(max(1, min(len(starts), 4 * spark.sparkContext.defaultParallelism)))
    return blocks.mapInPandas(draw, "replicate long, chunk long, times binary")


def _count_type(n_groups: int) -> str:
    return "<u2" if n_groups < 1 << 16 else "<u4"  # no count exceeds the number of groups


def twister_sample(stats: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """replicate, group_id, times: groups sorted by id and drawn with replacement from one stream, the same for all experiments."""
    groups, n = numbered_groups(stats)
    kind = _count_type(n)

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for replicate, chunk, times in frame[["replicate", "chunk", "times"]].itertuples(index=False):
                times = np.frombuffer(times, kind)
                at = np.flatnonzero(times)
                yield pd.DataFrame({"replicate": replicate, "at": at + chunk * CHUNK, "times": times[at].astype(np.int64)})

    rows = twister_counts(stats.sparkSession, n, replicates, seed).mapInPandas(listed, "replicate long, at long, times long")
    return rows.join(groups, "at").select("replicate", "group_id", "times")


def twister_metrics(stats: DataFrame, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """``replicate_metrics`` of ``twister_sample``, without a row for each group drawn: sums by chunks of groups."""
    groups, n = numbered_groups(stats)
    kind, names = _count_type(n), [*CELLS, "n", "nll", "brier"]
    facts = stats.join(groups, "group_id").select(F.expr(f"at div {CHUNK}").alias("chunk"), (F.col("at") % CHUNK).alias("place"), "experiment", *(F.col(c).cast("double").alias(c) for c in names))

    def add(counts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for experiment, own in rows.groupby("experiment"):
            for i in range(0, len(counts), 256):
                some = counts.iloc[i : i + 256]
                times = np.stack([np.frombuffer(t, kind) for t in some["times"]])[:, own["place"].to_numpy()]
                sums = pd.DataFrame(times.astype(float) @ own[names].to_numpy(), columns=names)
                parts.append(sums.assign(experiment=experiment, replicate=some["replicate"].to_numpy()))
        columns = ["experiment", "replicate", *names]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    drawn_ = twister_counts(stats.sparkSession, n, replicates, seed)
    schema = "experiment string, replicate long, " + ", ".join(f"{c} double" for c in names)
    partial = drawn_.groupBy("chunk").cogroup(facts.groupBy("chunk")).applyInPandas(add, schema)
    sums = partial.groupBy("experiment", "replicate").agg(*(F.sum(c).cast("long").alias(c) for c in (*CELLS, "n")), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"))
    return _metrics(sums.where("n > 0"))


# Fixed value: a prime below 2 ** 31, so that a square fits 64 bits.
PRIME = 2_147_483_647
# The cumulative Poisson(1) probabilities of 0 to 8.
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974020)


def hash_times(groups: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """How often each integer group (rows) is drawn in each replicate (columns): a Poisson draw of mean 1 by a hash.

    The hash mixes a linear form of both by three squarings modulo a prime, in 64-bit integers, so that SQL can draw the
    same sample; each group decides for itself.
    """
    g, r = groups.astype(np.int64)[:, None] % PRIME, replicates.astype(np.int64)[None, :]
    x = (g * 7919 + r * 104_729 + 12_345) % PRIME
    x = (x * x + g * 31 + r) % PRIME
    x = (x * x + g) % PRIME
    x = (x * x + r) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, "right")


def hash_metrics(stats: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """experiment, replicate and its metrics over samples of ``hash_times``; ``stats`` has an integer group_id.

    Each task adds its groups into one array of replicates by sums for each experiment; only those arrays are shuffled,
    whose number is that of the tasks and not of the groups.
    """
    names = [*CELLS, "n", "nll", "brier"]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        every = np.arange(replicates)
        for frame in frames:
            for experiment, own in frame.groupby("experiment"):
                total = sums.setdefault(experiment, np.zeros((replicates, len(names))))
                values = own[names].to_numpy(float)
                for i in range(0, len(own), 256):
                    total += hash_times(own["group_id"].to_numpy()[i : i + 256], every).T @ values[i : i + 256]
        for experiment, total in sums.items():
            yield pd.DataFrame(total, columns=names).assign(experiment=experiment, replicate=every)[["experiment", "replicate", *names]]

    facts = stats.select("experiment", F.col("group_id").cast("long").alias("group_id"), *(F.col(c).cast("double").alias(c) for c in names))
    partial = facts.mapInPandas(add, "experiment string, replicate long, " + ", ".join(f"{c} double" for c in names))
    sums = partial.groupBy("experiment", "replicate").agg(*(F.sum(c).cast("long").alias(c) for c in (*CELLS, "n")), F.sum("nll").alias("nll"), F.sum("brier").alias("brier"))
    return _metrics(sums.where("n > 0"))


def replicate_metrics(stats: DataFrame, sample: DataFrame) -> DataFrame:
    """experiment, replicate and its metrics; a replicate without one of the classes has null class metrics."""
    joined = sample.join(stats, "group_id")
    sums = joined.groupBy("experiment", "replicate").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in (*CELLS, "n", "nll", "brier")))
    return _metrics(sums)


def _metrics(sums: DataFrame) -> DataFrame:
    metrics = class_metrics(sums.select("experiment", "replicate", *CELLS)).select("experiment", "replicate", "macro_f1", "f1_1", "recall_1", "balanced_accuracy")
    both = (F.col("tp") + F.col("fn") > 0) & (F.col("tn") + F.col("fp") > 0)
    base = sums.select("experiment", "replicate", both.alias("both"), (F.col("nll") / F.col("n")).alias("nll"), (F.col("brier") / F.col("n")).alias("brier"))
    joined = base.join(metrics, ["experiment", "replicate"])
    return joined.select("experiment", "replicate", "nll", "brier", *(F.when(F.col("both"), F.col(c)).alias(c) for c in ("macro_f1", "f1_1", "recall_1", "balanced_accuracy")))


def intervals(values: DataFrame, keys: tuple[str, ...] = ("experiment",), level: float = 0.95) -> DataFrame:
    """keys, metric, percentile interval by linear interpolation, and how many replicates were defined or not."""
    names = [c for c, t in values.dtypes if t == "double"]
    long = values.unpivot([*keys, "replicate"], names, "metric", "value")
    low, high = (1 - level) / 2, 1 - (1 - level) / 2
    return long.groupBy(*keys, "metric").agg(F.expr(f"percentile(value, {low!r}D)").alias("low"), F.expr(f"percentile(value, {high!r}D)").alias("high"), F.count("value").alias("n_valid"), (F.count("*") - F.count("value")).alias("n_unavailable"))


def paired_differences(values: DataFrame, left: str, right: str) -> DataFrame:
    """Left minus right of each replicate."""
    names = [c for c, t in values.dtypes if t == "double"]
    a = values.where(F.col("experiment") == left).select("replicate", *(F.col(c).alias(f"{c}_a") for c in names))
    b = values.where(F.col("experiment") == right).select("replicate", *(F.col(c).alias(f"{c}_b") for c in names))
    return a.join(b, "replicate").select(F.lit(f"{left}-{right}").alias("experiment"), "replicate", *((F.col(f"{c}_a") - F.col(f"{c}_b")).alias(c) for c in names))
