"""Consolidating pairwise matches into groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.functions.text import identifier
from annotide.llm.components import minimum_labels, numbered
from annotide.storage import Scratch


def linked_groups(
    links: DataFrame,
    membership: DataFrame,
    ends: tuple[str, str] = ("example_id_1", "example_id_2"),
    member: str = "example_id",
    ids: str = "rule_b_group_ids",
) -> DataFrame:
    """group_id and id of every record in a group of two or more; group_id is the group's smallest id.

    A row of ``links`` links its two ends; records with a common id in ``ids`` (joined by ``|``) are linked through a
    vertex that stands for that id, so a large group has as many edges as members. Ids are trimmed and lower-cased.
    Null or empty ends, null cells, repeats and links of a record to itself change nothing; other columns are ignored;
    empty tables give no rows.
    """
    scratch = Scratch(links.sparkSession, "link-groups")
    pairs = links.select(identifier(ends[0]).alias("one"), identifier(ends[1]).alias("two")).dropna().where("one <> two")
    named = membership.select(identifier(member).alias("one"), F.explode(F.split(ids, "\\|")).alias("group"))
    named = named.select("one", identifier("group").alias("group")).dropna()
    # Records and ids are vertices of one graph, told apart by a letter; their numbers are free of collisions.
    record, hub = (lambda c: F.concat(F.lit("r"), c)), (lambda c: F.concat(F.lit("g"), c))
    edges = pairs.select(record("one").alias("one"), record("two").alias("two")).union(named.select(record("one"), hub("group")))
    numbers = numbered(edges.select(F.explode(F.array("one", "two")).alias("id")), scratch)
    edges = numbers.apply(numbers.apply(edges, "one", "a"), "two", "b")
    records = numbers.table.where(F.startswith("id", F.lit("r"))).select("v", F.substring("id", 2, 1 << 30).alias("id"))
    members = scratch.write(minimum_labels(edges, scratch).join(records, "v").select("label", "id"), "members")
    groups = members.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    return members.join(groups, "label").select("group_id", "id")
