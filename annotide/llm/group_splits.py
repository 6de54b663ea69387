"""Splits that keep related records together: an incremental, persisted component table.

The table has one row for each group id ever seen: id, component, split, and the component's number of records so far.
Records without ids stand in it with a null id. Of a batch of new records only what it touches is worked on:

* its ids are looked up in the table, and a known id stands for its whole component;
* that graph, of the batch's ids and the components they touch, is contracted by minimum labels with pointer jumping;
* the merged components' rows of the table are renamed, all other rows stay as they are.

A component that has a split keeps it, a new one fills the deficits of the wanted proportions over all records so far,
and one in which different splits meet is quarantined until it is settled: it has records, but no split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annotide.functions.text import identifier, strip
from annotide.llm.components import minimum_labels, numbered
from annotide.storage import Scratch

SHARES = {"train": 0.70, "dev_tune": 0.075, "dev_calibration": 0.075, "test": 0.15}
TABLE = "id string, component string, split string, n_records long"
#: Components of one size are ranked in so many parts, so that no task ranks all of them.
PARTS = 4096
#: A record without ids is named by its row after this. Ids are trimmed, so none starts with a blank.
ALONE = " row:"


def relations(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """row and id (trimmed, lower case) of every (table, key column, id column); null and empty ids relate nothing."""
    parts = [t.select(F.col(key).cast("long").alias("row"), identifier(i).alias("id")).dropna() for t, key, i in tables]
    first = parts[0]
    for part in parts[1:]:
        first = first.union(part)
    return first.distinct()


def split_records(manifest: DataFrame, key: str = "source_row", partition: str = "partition") -> DataFrame:
    """row and split of the records; repeated rows once, null keys left out, an empty partition as null."""
    rows = manifest.select(F.col(key).cast("long").alias("row"), F.nullif(strip(partition), F.lit("")).alias("split"))
    return rows.where("row is not null").distinct()


def _alone() -> Column:
    return F.concat(F.lit(ALONE), F.col("row").cast("string"))


def merge_batch(related: DataFrame, previous: DataFrame | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of the batch's ids: (row, name) as the table knows them, and (name, component) after the merge.

    The name of an id is its component's in ``previous``, or the id itself where the table doesn't know it. Components
    are named by their smallest id, so the smallest name of a merged component is its name.
    """
    if previous is None:
        named = related.select("row", "id", F.col("id").alias("name"))
    else:
        touched = related.select("id").distinct()
        known = previous.join(touched, "id", "left_semi").select("id", F.col("component").alias("known"))
        named = related.join(known, "id", "left").select("row", "id", F.coalesce("known", "id").alias("name"))
    named = scratch.write(named, "named")
    numbers = numbered(named.select(F.col("name").alias("id")), scratch)
    anchored = numbers.apply(named.select("row", "name").distinct(), "name", "a")
    anchors = anchored.groupBy("row").agg(F.min("a").alias("b"))
    labels = minimum_labels(anchored.join(anchors, "row").select("a", "b"), scratch)
    labels = scratch.write(labels.join(numbers.table, "v").select("label", F.col("id").alias("name")), "labels")
    smallest = labels.groupBy("label").agg(F.min("name").alias("component"))
    return named, scratch.write(labels.join(smallest, "label").select("name", "component"), "merged")


def _members(records: DataFrame, named: DataFrame, merged: DataFrame) -> DataFrame:
    """row, split, component of the batch's records; one without ids is a component of its own, named by its row."""
    own = named.groupBy("row").agg(F.min("name").alias("name")).join(merged, "name").select("row", "component")
    return records.join(own, "row", "left").select("row", "split", F.coalesce("component", _alone()).alias("component"))


def _sizes(members: DataFrame, renamed: DataFrame | None) -> DataFrame:
    """component, n_records, low and high (least and greatest split), held (whether it was in quarantine before)."""
    sizes = members.groupBy("component").agg(
        F.count("*").alias("n_records"), F.min("split").alias("low"), F.max("split").alias("high"), F.lit(False).alias("held")
    )
    if renamed is None:
        return sizes
    past = renamed.groupBy("old").agg(
        F.min("component").alias("component"), F.max("n_records").alias("n_records"), F.min("split").alias("low")
    )
    past = past.where("n_records > 0").select("component", "n_records", "low", F.col("low").alias("high"), F.col("low").isNull().alias("held"))
    return sizes.union(past).groupBy("component").agg(
        F.sum("n_records").alias("n_records"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("held").alias("held")
    )


def component_status(sizes: DataFrame) -> DataFrame:
    """component, n_records, status (kept, new or quarantined) and split (of kept ones)."""
    status = F.when(F.col("held"), "quarantined").when(F.col("low").isNull(), "new")
    status = status.when(F.col("low") == F.col("high"), "kept").otherwise("quarantined")
    return sizes.select("component", "n_records", status.alias("status"), F.when(status == "kept", F.col("low")).alias("split"))


def fill(deficit: dict[str, float], size: int, count: int) -> dict[str, int]:
    """How many of ``count`` components of one size each split gets; ``deficit`` is lowered by them.

    As if each in turn went to the split with the largest deficit: what is left of the deficits is levelled.
    """
    got = dict.fromkeys(deficit, 0)
    if count > 4 * len(deficit):
        ordered = sorted(deficit.values(), reverse=True)
        level = ordered[0]
        for k in range(1, len(ordered) + 1):  # the level down to which the k largest deficits can be filled
            level = (sum(ordered[:k]) - count * size) / k
            if k == len(ordered) or level >= ordered[k]:
                break
        for s, d in deficit.items():
            got[s] = max(0, math.floor((d - level) / size) - 1)
    for s, n in got.items():
        deficit[s] -= n * size
    for _ in range(count - sum(got.values())):
        best = max(deficit, key=lambda s: (deficit[s], s))
        got[best] += 1
        deficit[best] -= size
    return got


def settle(status: DataFrame, shares: dict[str, float] | None = None, release: bool = False) -> DataFrame:
    """``status`` with a split for every new component, and with ``release`` for the quarantined ones too.

    Open components go by size, largest first, to the split with the largest deficit; those of one size are ranked by
    a hash of their name. The driver holds only how many there are of each size: n records have fewer than
    sqrt(2 n) sizes. Kept components stay.
    """
    shares = shares or SHARES
    wanted = ["new", "quarantined"] if release else ["new"]
    is_open = F.col("status").isin(wanted)
    held = F.when(is_open, None).otherwise(F.col("split"))
    table = status.groupBy(is_open.alias("open"), held.alias("split"), F.when(is_open, F.col("n_records")).alias("size"))
    table = table.agg(F.count("*").alias("n"), F.sum("n_records").alias("records")).collect()  # one row a size or split
    if not any(r["open"] for r in table):
        return status
    totals = {r["split"]: r["records"] for r in table if not r["open"] and r["split"] in shares}
    everything = sum(totals.values()) + sum(r["records"] for r in table if r["open"])
    deficit = {s: share * everything - totals.get(s, 0) for s, share in shares.items()}
    quotas = []
    for r in sorted((r for r in table if r["open"]), key=lambda r: -r["size"]):
        at = 0
        for s, n in fill(deficit, r["size"], r["n"]).items():
            if n:
                quotas.append((r["size"], s, at, at + n))
                at += n
    quotas = status.sparkSession.createDataFrame(quotas, "n_records long, placed string, start long, stop long")
    spread = F.xxhash64("component")
    keyed = status.where(is_open).select("component", "n_records", F.pmod(spread, F.lit(PARTS)).alias("part"), spread.alias("h"))
    within = Window.partitionBy("n_records", "part")
    counts = keyed.groupBy("n_records", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_records").orderBy("part")) - F.col("n")
    counts = counts.select("n_records", "part", before.alias("before"))
    ranked = keyed.withColumn("at", F.row_number().over(within.orderBy("h", "component")) - 1).join(counts, ["n_records", "part"])
    ranked = ranked.select("component", "n_records", (F.col("at") + F.col("before")).alias("rank"))
    placed = ranked.join(quotas, "n_records").where("rank >= start and rank < stop").select("component", "placed")
    return status.join(placed, "component", "left").select(
        "component", "n_records", "status", F.when(is_open, F.col("placed")).otherwise(F.col("split")).alias("split")
    )


def batch_splits(
    records: DataFrame, related: DataFrame, previous: DataFrame | None = None, shares: dict[str, float] | None = None,
    release: bool = False, scratch: Scratch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """A batch end to end: row, component, status and split of its records, and the table to persist for the next batch.

    ``records`` has row (not seen in an earlier batch) and split (null where none is given), ``related`` row and id,
    ``previous`` is the table that the batch before returned. A component whose splits differ, in the table or in the
    batch, is quarantined with all its records, old and new; with ``release`` it is placed anew.
    """
    scratch = scratch or Scratch(records.sparkSession, "group-splits")
    named, merged = merge_batch(related, previous, scratch)
    members = scratch.write(_members(records, named, merged), "members")
    fresh = named.where("id = name").select("id", "name").distinct() if previous is None else named.select("id", "name").distinct()
    if previous is None:
        renamed = None
        rows = fresh.join(merged, "name").select("id", "component")
    else:
        renamed = previous.join(merged.select(F.col("name").alias("component"), F.col("component").alias("now")), "component", "left")
        renamed = renamed.select("id", F.col("component").alias("old"), F.coalesce("now", "component").alias("component"), "n_records", "split")
        renamed = scratch.write(renamed, "renamed")
        unknown = fresh.where("id = name").join(previous.select("id"), "id", "left_anti")
        rows = renamed.where("id is not null").select("id", "component").union(unknown.join(merged, "name").select("id", "component"))
    final = scratch.write(settle(component_status(_sizes(members, renamed)), shares, release), "final")
    placed = members.select("row", "component").distinct().join(final.select("component", "status", "split"), "component")
    table = rows.join(final, "component", "left").select("id", "component", "split", "n_records")
    single = final.where(F.startswith("component", F.lit(ALONE)))
    single = single.select(F.lit(None).cast("string").alias("id"), "component", "split", "n_records")
    return placed.select("row", "component", "status", "split"), scratch.write(table.union(single), "table")


def split_in_batches(
    batches: list[tuple[DataFrame, DataFrame]], shares: dict[str, float] | None = None, release: bool = False
) -> DataFrame:
    """row, component, status and split of the records of all batches, (records, related) each, after the last of them.

    The table of each batch is written to the shared folder and read by the next one. ``release`` places what is in
    quarantine after the last batch.
    """
    table, done, last = None, [], len(batches) - 1
    for i, (records, related) in enumerate(batches):
        scratch = Scratch(records.sparkSession, "group-splits")
        placed, table = batch_splits(records, related, table, shares, release and i == last, scratch)
        done.append(scratch.write(placed, "placed"))
    if not last:
        return done[0]
    # Components are named by an id or by a row, and the table tells in which component either is by now.
    rows = done[0].select("row", F.col("component").alias("was"))
    for placed in done[1:]:
        rows = rows.union(placed.select("row", "component"))
    now = table.select(F.coalesce("id", "component").alias("was"), "component", "split")
    waiting = F.when(F.col("split").isNull(), "quarantined")
    present = rows.join(now, "was").select("row", "component", "split", waiting.alias("waiting"))
    status = done[0].select("row", "status")
    for placed in done[1:]:
        status = status.union(placed.select("row", "status"))
    return present.join(status, "row").select("row", "component", F.coalesce("waiting", "status").alias("status"), "split")


def conflicting_records(placed: DataFrame) -> DataFrame:
    """The rows of quarantined components."""
    return placed.where("status = 'quarantined'").select("row").distinct()


def split_balance(placed: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """Of each split: n_records, share, wanted, n_components, and n_spread, its components that other splits hold too."""
    shares = shares or SHARES
    wanted = placed.sparkSession.createDataFrame(list(shares.items()), "split string, wanted double")
    per = placed.where("split is not null").groupBy("component", "split").agg(F.count("*").alias("n"))
    spread = per.groupBy("component").agg(F.count("*").alias("splits"))
    sums = per.join(spread, "component").groupBy("split").agg(
        F.sum("n").alias("n_records"), F.count("*").alias("n_components"), F.count(F.when(F.col("splits") > 1, 1)).alias("n_spread")
    )
    joined = wanted.join(sums, "split", "left").withColumn("total", F.sum("n_records").over(Window.partitionBy(F.lit(1))))  # a row a split
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.round(F.coalesce(F.col("n_records") / F.col("total"), F.lit(0.0)), 6)
    return joined.select("split", count("n_records"), share.alias("share"), "wanted", count("n_components"), count("n_spread"))
