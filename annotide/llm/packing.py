"""Filling containers with items: variable-capacity best fit on counts.

Several sequence lengths are permitted, up to the container. Items of one size are alike, and no size exceeds the
container, so the plan is made on the number of items of each size: a table of at most ``container`` rows, whatever the
number of items. From the longest size down, the items of a size go into the open bins in which they leave the least
room. Where none has room, bins of the least-cost length are opened: the share of the length that the items still to
come cannot fill and, where lengths tie, the length itself, as the work on a sequence grows faster than its length. At
the end each bin is downsized to the smallest permitted length that holds its contents, and bins are set side by side
in containers by the same best fit.

Which lengths pay is settled jointly, by carrying out the whole plan for every set of permitted lengths, each with
several bounds on how much of a bin shorter than the container its first item may take (short bins that begin with a
long item are hard to fill). The plan with the fewest containers is taken, of those the one with the least sum of squared
lengths. Plain best fit into containers is one of the plans, so no container more is used than by that.

The items are then ranked within their size in parallel and take the places that the plan has for those ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annotide.storage import Scratch

CONTAINER = 2048
LENGTHS = (512, 1024, 1536, 2048)
#: Parts of a bin shorter than the container that its first item may take, as tried.
SHARES = (1.0, 0.5, 0.125)
#: Items of one size are ranked in so many parts, so that no task ranks all of them.
PARTS = 1024


class Plan:
    """Groups of equal bins: the sizes in a bin, its length, and how many there are."""

    def __init__(self, counts: np.ndarray, lengths: tuple[int, ...], share: float = 1.0):
        """``counts[s]`` items of size s; the last of ``lengths`` is the largest size.

        The first item of a shorter bin may take ``share`` of it.
        """
        self.lengths = tuple(sorted(lengths))
        self.bins: list[tuple[tuple[int, ...], int, int]] = []
        room: list[list[tuple[tuple[int, ...], int, int]]] = [[] for _ in range(self.lengths[-1] + 1)]  # open bins by room
        mask = 0  # bit r: a bin with room r is open
        rest = int((counts * np.arange(len(counts))).sum())
        for size in range(self.lengths[-1], 0, -1):
            n = int(counts[size])
            while n:
                fits = mask >> size
                if fits:
                    r = size + (fits & -fits).bit_length() - 1
                    content, length, times = room[r].pop()
                    k = min(n, times)
                    if k < times:
                        room[r].append((content, length, times - k))
                    if not room[r]:
                        mask &= ~(1 << r)
                else:
                    able = [c for c in self.lengths if size <= share * c] or self.lengths[-1:]
                    length = min(able, key=lambda c: (max(0, c - rest) / c, c))
                    content, k = (), min(n, max(1, rest // length))
                n -= k
                rest -= k * size
                content = (*content, size)
                r = length - sum(content)
                if r:
                    room[r].append((content, length, k))
                    mask |= 1 << r
                else:
                    self.bins.append((content, length, k))
        for groups in room:
            self.bins += groups
        self.bins = [(content, next(c for c in self.lengths if c >= sum(content)), times) for content, _, times in self.bins]

    def by_length(self) -> np.ndarray:
        """The number of bins of each length."""
        return np.bincount([length for _, length, _ in self.bins], [k for *_, k in self.bins], self.lengths[-1] + 1).astype(np.int64)

    def cost(self) -> tuple[int, int]:
        """Containers, and the sum of squared lengths."""
        containers = Plan(self.by_length(), self.lengths[-1:])
        return sum(k for *_, k in containers.bins), sum(k * length * length for _, length, k in self.bins)


def best_plan(counts: np.ndarray, lengths: tuple[int, ...]) -> Plan:
    """The plan of least cost over the sets of permitted lengths; the container is in each of them."""
    *short, container = sorted(lengths)
    plans = [Plan(counts, (container,))]
    for k in range(1, len(short) + 1):
        for some in combinations(short, k):
            plans += [Plan(counts, (*some, container), share) for share in SHARES]
    return min(plans, key=Plan.cost)


class Places:
    """For items by size and rank: the bin, its length and its container."""

    def __init__(self, plan: Plan, container: int):
        by_length = np.zeros(container + 1, dtype=np.int64)
        first, entries, bins = 0, {}, {}
        for content, length, times in plan.bins:
            for size in set(content):
                entries.setdefault(size, []).append((content.count(size), first, times))
            bins.setdefault(length, []).append((first, by_length[length], times))
            by_length[length] += times
            first += times
        # of each size: the rank from which an entry holds, items a bin, its first bin
        self.sizes = {s: self._ranks(e, lambda x: x[0] * x[2]) for s, e in entries.items()}
        self.starts = np.array([b for length in bins for b, _, _ in bins[length]], dtype=np.int64)
        order = np.argsort(self.starts)
        self.starts = self.starts[order]
        self.length = np.array([length for length in bins for _ in bins[length]], dtype=np.int64)[order]
        self.rank = np.array([r for length in bins for _, r, _ in bins[length]], dtype=np.int64)[order]  # of its first bin among that length
        outer, first, held = Plan(by_length, (container,)), 0, {}
        for content, _, times in outer.bins:
            for length in set(content):
                held.setdefault(length, []).append((content.count(length), first, times))
            first += times
        self.containers = {length: self._ranks(e, lambda x: x[0] * x[2]) for length, e in held.items()}

    @staticmethod
    def _ranks(entries: list[tuple[int, int, int]], items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        upto = np.cumsum([items(x) for x in entries])
        return np.r_[0, upto[:-1]], np.array([x[0] for x in entries]), np.array([x[1] for x in entries])

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray, np.ndarray], ranks: np.ndarray) -> np.ndarray:
        start, each, first = table
        at = np.searchsorted(start, ranks, "right") - 1
        return first[at] + (ranks - start[at]) // each[at]

    def find(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, containers = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            own = sizes == size
            bins[own] = self._find(self.sizes[int(size)], ranks[own])
        at = np.searchsorted(self.starts, bins, "right") - 1
        lengths, within = self.length[at], self.rank[at] + bins - self.starts[at]
        for length in np.unique(lengths):
            own = lengths == length
            containers[own] = self._find(self.containers[int(length)], within[own])
        return bins, lengths, containers


def _assign(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            found = places.find(size, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, found)], names=["item", "piece", "size", "bin", "length", "container"])

    return run


def ranked(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` with the rank of each among those of its size, and the number of each size."""
    keyed = pieces.withColumn("part", F.pmod(F.xxhash64("item", "piece"), F.lit(PARTS)))
    counts = keyed.groupBy("size", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("size").orderBy("part")) - F.col("n")  # at most PARTS rows of a size
    counts = counts.select("size", "part", "n", before.alias("before"))
    within = Window.partitionBy("size", "part").orderBy("item", "piece")
    rows = keyed.withColumn("at", F.row_number().over(within) - 1).join(counts, ["size", "part"])
    sizes = pieces.groupBy("size").agg(F.count("*").alias("n")).collect()  # no more rows than the container has tokens
    return rows.select("item", "piece", "size", (F.col("at") + F.col("before")).alias("rank")), {r["size"]: r["n"] for r in sizes}


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", container: int = CONTAINER, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """Each piece of an item with its place: item, piece, start, size, bin, length (of the bin), container (its number).

    ``sizes`` has ``key`` (BIGINT) and ``size``. Items of null or no size take no space and are in no row, as are null
    keys; a key that is repeated counts once, with its greatest size. Only an item longer than the container is split,
    into full containers and a rest. The length of a bin is a permitted one, and the bins of a container are together
    no longer than it; other columns are ignored; an empty table gives no rows.
    """
    if max(lengths) > container:
        raise ValueError("a permitted length exceeds the container")
    lengths = tuple(sorted({*lengths, container}))
    scratch = Scratch(sizes.sparkSession, "packing")
    items = sizes.select(F.col(key).cast("long").alias("item"), F.col(size).cast("long").alias("size")).where("item is not null and size > 0")
    items = items.groupBy("item").agg(F.max("size").alias("size"))
    cut = F.expr(f"transform(sequence(0L, (size - 1) div {container}), i -> least({container}L, size - i * {container}L))")
    pieces = scratch.write(items.select("item", F.posexplode(cut).alias("piece", "size")), "pieces")
    rows, numbers = ranked(pieces)
    counts = np.zeros(container + 1, dtype=np.int64)
    for s, n in numbers.items():
        counts[s] = n
    places = Places(best_plan(counts, lengths), container)
    found = rows.mapInArrow(_assign(places), "item long, piece int, size long, bin long, length long, container long")
    return found.select("item", "piece", (F.col("piece").cast("long") * container).alias("start"), "size", "bin", "length", "container")


def fill_report(packed_items: DataFrame, container: int = CONTAINER) -> DataFrame:
    """Bins, containers, tokens, room of bins and of containers, and the share of either room that is unused (null if none).

    One row for each length of a bin (n_containers null), and one for all, of which the length is null.
    """
    bins = packed_items.groupBy("bin").agg(F.sum("size").alias("used"), F.max("length").alias("length"), F.max("container").alias("container"))
    by = bins.groupBy("length").agg(F.count("*").alias("n_bins"), F.sum("used").alias("n_tokens"), F.sum("length").alias("n_room"))
    every = by.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_bins", "n_tokens", "n_room")))
    containers = bins.agg(F.coalesce(F.max("container") + 1, F.lit(0)).alias("n_containers"))
    unused = lambda room: F.when(room > 0, F.round(1 - F.col("n_tokens") / room, 6))
    total = every.withColumn("one", F.lit(1)).join(containers.withColumn("one", F.lit(1)), "one")  # one row each
    room = F.col("n_containers") * container
    total = total.select(
        F.lit(None).cast("long").alias("length"), "n_bins", "n_tokens", "n_room", unused(F.col("n_room")).alias("unused"),
        "n_containers", unused(room).alias("unused_of_containers"),
    )
    none = F.lit(None)
    parts = by.select(
        "length", "n_bins", "n_tokens", "n_room", unused(F.col("n_room")).alias("unused"),
        none.cast("long").alias("n_containers"), none.cast("double").alias("unused_of_containers"),
    )
    return parts.union(total)
