"""Exact text reuse: inverted index, links, overlap groups by three rules, roll-ups and leakage checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annotide.functions import text as tx
from annotide.operators.components import connected_components
from annotide.operators.labels import FIELDS
from annotide.storage import Scratch

LEAST_WORDS = 5
SETTINGS = ("original", "whitespace_casefold")


def inverted_index(rows: DataFrame) -> DataFrame:
    """setting, value, example_id, field, words of every text that isn't blank.

    ``rows`` has example_id, source_row and the three texts. Under ``original`` the value stands for the text as it is,
    under ``whitespace_casefold`` for its normal form: it is the text's SHA-256 (32 bytes), so that no text is shuffled.
    """
    long = rows.select("example_id", F.expr("stack(3, 'preceding', preceding, 'target', target, 'following', following) as (field, text)"))
    long = long.withColumn("normalized", tx.normal("text")).where("length(normalized) > 0")
    digest = lambda c: F.unhex(F.sha2(c, 256)).alias("value")
    pairs = F.array(*(F.struct(F.lit(setting).alias("setting"), digest(c)) for setting, c in zip(SETTINGS, ("text", "normalized"), strict=True)))
    return long.select("example_id", "field", tx.word_count(F.col("normalized")).alias("words"), F.inline(pairs)).select("setting", "value", "example_id", "field", "words").distinct()


def hexed(value: Column | str) -> Column:
    """A value as hexadecimal digits."""
    return F.lower(F.hex(value))


def shared_values(index: DataFrame) -> DataFrame:
    """setting, value of every value that two or more examples hold; min and max are combined before the shuffle."""
    return index.groupBy("setting", "value").agg(F.min("example_id").alias("low"), F.max("example_id").alias("high")).where("low <> high").select("setting", "value", F.col("low").alias("first_id"))


def link_type(field_1: Column, field_2: Column, setting: Column, words: Column, least: int = LEAST_WORDS) -> Column:
    kind = F.when((field_1 == "target") & (field_2 == "target"), "target_target").when((field_1 == "target") | (field_2 == "target"), "target_context").otherwise("context_context")
    return F.concat(kind, F.when((setting == SETTINGS[1]) & (words >= least), "_substantial").otherwise("_short_or_unthresholded"))


def overlap_links(index: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Every unordered pair of places in different examples that share a value. For classes instead, see ``value_classes``."""
    held = index.join(shared_values(index).select("setting", "value"), ["setting", "value"], "left_semi")
    a = held.select("setting", "value", F.col("example_id").alias("example_id_1"), F.col("field").alias("field_1"), "words")
    b = held.select("setting", "value", F.col("example_id").alias("example_id_2"), F.col("field").alias("field_2"))
    pairs = a.join(b, ["setting", "value"]).where("example_id_1 < example_id_2")
    return pairs.select(
        F.col("setting").alias("comparison_setting"), "example_id_1", "field_1", "example_id_2", "field_2", hexed("value").alias("normalized_text_sha256"), F.col("words").alias("word_count"),
        link_type(F.col("field_1"), F.col("field_2"), F.col("setting"), F.col("words"), least).alias("link_type"),
    ).distinct()


def value_classes(index: DataFrame) -> DataFrame:
    """One row a place that shares its value: the value's class (hash and first example), linear in the input."""
    joined = index.join(shared_values(index), ["setting", "value"])
    return joined.select("setting", hexed("value").alias("class_id"), "first_id", "example_id", "field", "words")


def rule_edges(index: DataFrame, rule: str, least: int = LEAST_WORDS) -> DataFrame:
    """Star edges (a example, b the first example with the value) of a rule: ``five`` (values of ``least`` words or more),
    ``a`` (those, and targets repeated at any length) or ``b`` (any shared value)."""
    index = index.where(F.col("setting") == SETTINGS[1])
    if rule == "five":
        parts = [index.where(F.col("words") >= least)]
    elif rule == "a":
        parts = [index.where(F.col("words") >= least), index.where("field = 'target'")]
    elif rule == "b":
        parts = [index]
    else:
        raise ValueError(f"no rule {rule}")
    edges = None
    for part in parts:
        star = part.select("value", "example_id").join(part.groupBy("value").agg(F.min("example_id").alias("first"), F.max("example_id").alias("last")).where("first <> last"), "value")
        star = star.select(F.col("example_id").alias("a"), F.col("first").alias("b"))
        edges = star if edges is None else edges.union(star)
    return edges


def _content_ids(prefix: str, digits: int):
    """Rows come sorted by root and id; a group passes by as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, digest = None, None
        done: tuple[list, list] = ([], [])
        for batch in batches:
            for r, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if r != root:
                    if root is not None:
                        done[0].append(root)
                        done[1].append(prefix + digest.hexdigest()[:digits])
                    root, digest = r, hashlib.sha256(i.encode())
                else:
                    digest.update(b"|" + i.encode())
        if root is not None:
            done[0].append(root)
            done[1].append(prefix + digest.hexdigest()[:digits])
        yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.string()), pa.array(done[1], pa.string())], names=["root", "group_id"])

    return run


def groups(rows: DataFrame, index: DataFrame, rule: str, least: int = LEAST_WORDS, digits: int = 16) -> DataFrame:
    """example_id and group_id of every row under a rule, singletons included.

    A group's id is a hash of its sorted members, so it doesn't depend on the order of the input.
    """
    prefix = {"five": "five-", "a": "rule-a-", "b": "rule-b-"}[rule]
    roots = connected_components(rule_edges(index, rule, least), name=rule)
    members = rows.select("example_id").distinct().join(roots.withColumnRenamed("id", "example_id"), "example_id", "left").select("example_id", F.coalesce("root", "example_id").alias("root"))
    members = Scratch(rows.sparkSession, "groups").write(members, rule)
    ids = members.select("root", "example_id").repartition("root").sortWithinPartitions("root", "example_id").mapInArrow(_content_ids(prefix, digits), "root string, group_id string")
    return members.join(ids, "root").select("example_id", "group_id")


def group_statistics(members: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """One row: groups, singletons, larger ones, examples in those, the largest, and groups with a positive example."""
    if positives is not None:
        members = members.join(positives.select("example_id", "hard_label"), "example_id", "left")
    else:
        members = members.withColumn("hard_label", F.lit(None).cast("int"))
    sizes = members.groupBy("group_id").agg(F.count("*").alias("size"), F.coalesce(F.sum("hard_label"), F.lit(0)).alias("pos"))
    return sizes.agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("size") == 1).alias("n_singletons"), F.count_if(F.col("size") > 1).alias("n_nontrivial"),
        F.coalesce(F.sum(F.when(F.col("size") > 1, F.col("size"))), F.lit(0)).alias("n_in_nontrivial"), F.max("size").alias("largest"), F.count_if(F.col("pos") > 0).alias("n_with_positive"),
    )


def size_histogram(members: DataFrame) -> DataFrame:
    return members.groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def _row(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_violations")).select(F.lit(name).alias("check"), "n_violations")


def torn(places: DataFrame, members: DataFrame) -> DataFrame:
    """Values of ``places`` (value, example_id) that two or more groups of ``members`` hold."""
    held = places.join(members, "example_id").groupBy("value").agg(F.min("group_id").alias("a"), F.max("group_id").alias("b"))
    return held.where("a <> b").select("value")


def grouping_checks(rows: DataFrame, index: DataFrame, a: DataFrame, b: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """check, n_violations of the groupings by rule A and rule B: all examples are members, repeated targets and shared
    texts of ``least`` words or more stay within a group, and no group of A reaches into two of B."""
    normal = index.where(F.col("setting") == SETTINGS[1])
    targets, long = normal.where("field = 'target'"), normal.where(F.col("words") >= least)
    ids = rows.select("example_id").distinct()
    out = None
    for rule, members in (("a", a), ("b", b)):
        lost = ids.join(members, "example_id", "left_anti").union(members.select("example_id").join(ids, "example_id", "left_anti"))
        parts = ((lost, "members"), (torn(targets, members), "repeated_targets"), (torn(long, members), "long_texts"))
        for violations, name in parts:
            one = _row(violations, f"rule_{rule}_{name}")
            out = one if out is None else out.union(one)
    return out.union(_row(torn(a.select("example_id", F.col("group_id").alias("value")), b), "rule_a_within_rule_b"))


def merges(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """Groups of ``outer`` that merge two or more of ``inner``: their size and number of merged groups."""
    joined = outer.withColumnRenamed("group_id", "outer_id").join(inner.withColumnRenamed("group_id", "inner_id"), "example_id")
    parts = joined.groupBy("outer_id", "inner_id").agg(F.count("*").alias("n"))
    return parts.groupBy("outer_id").agg(F.count("*").alias("n_merged"), F.sum("n").alias("size")).where("n_merged > 1")


def shared_rollup(index: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Per setting: values shared, those of ``least`` words or more, examples affected, and examples whose target stands in another's context."""
    per = index.groupBy("setting", "value").agg(
        F.min("example_id").alias("low"), F.max("example_id").alias("high"), F.max("words").alias("words"), F.min(F.when(F.col("field") == "target", F.col("example_id"))).alias("target_low"),
        F.min(F.when(F.col("field") != "target", F.col("example_id"))).alias("context_low"), F.max(F.when(F.col("field") != "target", F.col("example_id"))).alias("context_high"),
    ).where("low <> high")
    values = per.groupBy("setting").agg(F.count("*").alias("n_shared"), F.count_if(F.col("words") >= least).alias("n_substantial"))
    held = index.join(per.select("setting", "value", "context_low", "context_high"), ["setting", "value"])
    elsewhere = (F.col("field") == "target") & ((F.col("context_low") != F.col("example_id")) | (F.col("context_high") != F.col("example_id")))
    # one row an example first, so the distinct counts are plain sums
    each = held.groupBy("setting", "example_id").agg(F.max(F.coalesce(elsewhere, F.lit(False)).cast("int")).alias("elsewhere"))
    affected = each.groupBy("setting").agg(F.count("*").alias("n_examples"), F.sum("elsewhere").alias("n_target_elsewhere"))
    return values.join(affected, "setting").select("setting", "n_shared", "n_substantial", "n_examples", "n_target_elsewhere")


def link_categories(index: DataFrame) -> DataFrame:
    """Of each shared normalized value: its number of links, and which kinds of places they join.

    Links are counted from the places that a value has in each example, so nothing is paired: links of a kind are all
    pairs of such places less those within one example.
    """
    own = index.where(F.col("setting") == SETTINGS[1]).groupBy("value", "example_id").agg(
        F.count_if(F.col("field") == "target").alias("t"), F.count_if(F.col("field") != "target").alias("c"), F.max("words").alias("words")
    )
    t, c = F.col("t"), F.col("c")
    sums = own.groupBy("value").agg(
        F.max("words").alias("word_count"), F.count("*").alias("n"), F.sum(t).alias("st"), F.sum(c).alias("sc"),
        F.sum(t * t).alias("tt"), F.sum(c * c).alias("cc"), F.sum(t * c).alias("tc"),
    ).where("n > 1")
    pairs = {k: (F.col(f"s{k}") * F.col(f"s{k}") - F.col(k * 2)) / 2 for k in ("t", "c")}
    mixed = F.col("st") * F.col("sc") - F.col("tc")
    flag = lambda x, name: (x > 0).cast("int").alias(name)
    return sums.select(
        hexed("value").alias("normalized_text_sha256"), "word_count", (pairs["t"] + pairs["c"] + mixed).cast("long").alias("n_links"),
        flag(pairs["t"], "has_target_target"), flag(mixed, "has_target_context"), flag(pairs["c"], "has_context_context"),
    )


def review_shortlist(categories: DataFrame, merging: DataFrame, per_stratum: int = 1, short: int = 4, least: int = LEAST_WORDS) -> DataFrame:
    """A few values for a person to look at: the first by hash in each stratum, and the longest of the short ones.

    Of the short ones only those in ``merging`` count, which join two groups of rule A.
    """
    stratum = F.concat_ws("+", F.when(F.col("has_target_target") == 1, "tt"), F.when(F.col("has_target_context") == 1, "tc"), F.when(F.col("has_context_context") == 1, "cc"))
    long = categories.where(F.col("word_count") >= least).withColumn("stratum", stratum)
    first = long.withColumn("k", F.row_number().over(Window.partitionBy("stratum").orderBy("normalized_text_sha256"))).where(F.col("k") <= per_stratum)
    few = categories.join(merging.select("normalized_text_sha256"), "normalized_text_sha256", "left_semi")
    few = few.orderBy(F.desc("word_count"), "normalized_text_sha256").limit(short).withColumn("stratum", F.lit("short"))
    columns = ["stratum", "normalized_text_sha256", "word_count", "n_links"]
    return first.select(columns).union(few.select(columns))


def upsert_notes(fresh: DataFrame, notes: DataFrame, key: str = "case_id") -> tuple[DataFrame, DataFrame]:
    """(``fresh`` with the notes written earlier, notes whose case is gone). A caller stops if there are any of those."""
    kept = fresh.join(notes.select(key, "note"), key, "left").withColumn("note", F.coalesce("note", F.lit("")))
    return kept, notes.join(fresh, key, "left_anti")


def group_summary(members: DataFrame, rows: DataFrame, rule: str) -> DataFrame:
    """Per group: size, positives, others, votes by label and examples by agreement."""
    joined = members.join(rows.select("example_id", "votes", "hard_label", "agreement"), "example_id")
    votes = lambda v: F.coalesce(F.sum(F.size(F.filter("votes", lambda x: x == v))), F.lit(0))
    return joined.groupBy("group_id").agg(
        F.count("*").alias("size"), F.count_if(F.col("hard_label") == 1).alias("positive"), F.count_if(F.col("hard_label") == 0).alias("other"),
        votes(-1).alias("votes_minus1"), votes(0).alias("votes_zero"), votes(1).alias("votes_one"),
        F.count_if(F.col("agreement") == "unanimous").alias("unanimous"), F.count_if(F.col("agreement") == "two-versus-one").alias("two_versus_one"), F.count_if(F.col("agreement") == "all-different").alias("all_different"),
    ).select(F.lit(rule).alias("rule"), "*")


def leakage(index: DataFrame, splits: DataFrame) -> DataFrame:
    """Normalized values that stand in more than one partition: hash, words, partitions and examples."""
    values = index.where(F.col("setting") == SETTINGS[1]).join(splits.select("example_id", "partition").distinct(), "example_id")
    per = values.groupBy("value", "partition").agg(F.countDistinct("example_id").alias("n"), F.max("words").alias("words"))
    return per.groupBy("value").agg(F.count("*").alias("n_partitions"), F.sum("n").alias("n_examples"), F.max("words").alias("words")).where("n_partitions > 1").select(hexed("value").alias("value_sha256"), "words", "n_partitions", "n_examples")


def repeated_targets(rows: DataFrame) -> DataFrame:
    """Normalized targets of two or more rows: rows, and whether their votes differ."""
    votes = F.concat_ws(",", *(F.coalesce(F.col(v).cast("string"), F.lit("?")) for v in ("v1", "v2", "v3")))
    per = rows.where("length(norm_target) > 0").groupBy("norm_target").agg(F.count("*").alias("n_rows"), F.min(votes).alias("a"), F.max(votes).alias("b"))
    return per.where("n_rows > 1").select(F.sha2("norm_target", 256).alias("target_sha256"), "n_rows", (F.col("a") != F.col("b")).cast("int").alias("conflicting"))


def repeated_triplets(rows: DataFrame, normalized: bool = True) -> DataFrame:
    """Whole triples of texts that two or more rows have."""
    names = [f"norm_{f}" if normalized else f for f in FIELDS]
    parts = [F.coalesce(F.col(n), F.lit("")) for n in names]
    return rows.groupBy(*(p.alias(f"k{i}") for i, p in enumerate(parts))).agg(F.count("*").alias("n_rows")).where("n_rows > 1").select(F.sha2(F.concat_ws(chr(31), "k0", "k1", "k2"), 256).alias("triplet_sha256"), "n_rows")


def short_merges(index: DataFrame, inner: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """Shared values below ``least`` words that join two or more groups of ``inner``: hash, words, examples, and groups joined."""
    short = index.where((F.col("setting") == SETTINGS[1]) & (F.col("words") < least)).join(inner, "example_id")
    per = short.groupBy("value", "words", "group_id", "example_id").agg(F.lit(1).alias("one")).groupBy("value", "words", "group_id").agg(F.count("*").alias("n"))
    per = per.groupBy("value", "words").agg(F.sum("n").alias("n_examples"), F.count("*").alias("n_groups")).where("n_groups > 1")
    return per.select(hexed("value").alias("normalized_text_sha256"), "words", "n_examples", "n_groups")


def rule_comparison(index: DataFrame, five: DataFrame, a: DataFrame, b: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """measure, n: what rule B merges beyond rule A, the short texts behind it, and what repeated targets add to long texts alone."""
    merged = merges(a, b)
    short = short_merges(index, a, least)
    targets = index.where((F.col("setting") == SETTINGS[1]) & (F.col("field") == "target")).select("value", "example_id").join(five, "example_id")
    per = targets.groupBy("value", "group_id").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"))
    joining = per.where("n_groups > 1")
    affected = targets.join(joining.select("value"), "value", "left_semi").select("example_id").distinct()
    row = lambda df, name, value: df.agg(F.coalesce(value, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("measure"), "n")
    every = F.count(F.lit(1))
    return (
        row(merged, "rule_b_groups_that_merge", every).union(row(merged, "examples_in_them", F.sum("size")))
        .union(row(short, "short_texts_that_merge", every)).union(row(joining, "repeated_targets_that_merge", every))
        .union(row(joining, "five_word_groups_merged", F.sum(F.col("n_groups") - 1))).union(row(affected, "examples_of_repeated_targets", every))
    )
