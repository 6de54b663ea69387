"""The queries of the training-data operators, by name: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.storage import Scratch, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.split_overlap import cross_split_pairs

    pairs = cross_split_pairs(table(spark, sf, "autalic"), table(spark, sf, "split_manifest"))
    return pairs.select(F.least("row_other", "row_train").alias("source_row_1"), F.greatest("row_other", "row_train").alias("source_row_2")).distinct()


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.split_overlap import overlap_report

    return overlap_report(table(spark, sf, "autalic"), table(spark, sf, "split_manifest"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.format_copies import copy_pairs

    return copy_pairs(table(spark, sf, "autalic")).select(F.col("row_1").alias("source_row_1"), F.col("row_2").alias("source_row_2"))


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.format_copies import copy_groups

    return copy_groups(table(spark, sf, "autalic")).where("row = first").select(F.col("row").alias("source_row"), "n_copies")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.shared_spans import shared_spans

    spans = shared_spans(table(spark, sf, "autalic"))
    return spans.select(F.col("row_1").alias("source_row_1"), F.col("row_2").alias("source_row_2")).distinct()


def p3_share(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.shared_spans import shared_share

    return shared_share(table(spark, sf, "autalic")).withColumnRenamed("row", "source_row")


def _p4_placed(spark: SparkSession, sf: str, release: bool = False) -> DataFrame:
    """The manifest's records in two batches: those that an outer split was set for, then those that came without one."""
    from annotide.functions.text import strip
    from annotide.llm.group_splits import relations, split_in_batches, split_records

    manifest, targets = table(spark, sf, "split_manifest"), table(spark, sf, "targets")
    scratch = Scratch(spark, "p4")
    related = scratch.write(relations([(manifest, "source_row", "group_id"), (targets, "source_row", "rule_b_group_id")]), "related")
    records = split_records(manifest)
    outer = manifest.select(F.col("source_row").alias("row"), F.nullif(strip("outer_split"), F.lit("")).alias("outer"))
    late = scratch.write(outer.groupBy("row").agg(F.max("outer").alias("outer")).where("outer is null").select("row"), "late")
    batches = [(records.join(late, "row", how), related.join(late, "row", how)) for how in ("left_anti", "left_semi")]
    return split_in_batches(batches, release=release)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.group_splits import conflicting_records

    return conflicting_records(_p4_placed(spark, sf)).withColumnRenamed("row", "source_row")


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    """What is in quarantine has no split here; ``p4_settled`` places it too."""
    return _p4_placed(spark, sf).withColumnRenamed("row", "source_row")


def p4_settled(spark: SparkSession, sf: str) -> DataFrame:
    return _p4_placed(spark, sf, release=True).withColumnRenamed("row", "source_row")


def p4_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Of each split of ``p4_settled``: components that other splits hold too."""
    from annotide.llm.group_splits import split_balance

    return split_balance(_p4_placed(spark, sf, release=True)).select("split", "wanted", "n_spread")


def _p5_rows(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.functions.text import strip

    return table(spark, sf, "autalic").select(strip("example_id").alias("item"), "source_row").dropna().distinct()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.consensus import consensus, valid_votes

    labels, _ = consensus(valid_votes(table(spark, sf, "annotation_votes")))
    odd = labels.where("top_votes >= 2 and consensus_label <> plurality_label")
    return odd.join(_p5_rows(spark, sf), "item").select("source_row", "consensus_label")


def p5_labels(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.consensus import consensus, valid_votes

    labels, _ = consensus(valid_votes(table(spark, sf, "annotation_votes")))
    return labels.join(_p5_rows(spark, sf), "item", "right").select(
        "source_row", "consensus_label", F.round("credibility", 4).alias("credibility"), F.coalesce("n_votes", F.lit(0)).alias("n_votes"), F.round("agreement", 6).alias("agreement")
    )


def p5_annotators(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.consensus import annotator_reliability, consensus, valid_votes

    _, params = consensus(valid_votes(table(spark, sf, "annotation_votes")))
    return annotator_reliability(params)


def p5_agreement(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.consensus import krippendorff, valid_votes

    return krippendorff(valid_votes(table(spark, sf, "annotation_votes")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.link_groups import linked_groups

    groups = linked_groups(table(spark, sf, "overlap_links"), table(spark, sf, "group_membership"))
    return groups.select(F.col("group_id").alias("group_example_id"), F.col("id").alias("example_id"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.encoding import encoded

    return encoded(table(spark, sf, "documents"))


def p9_pack(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.encoding import token_counts
    from annotide.llm.packing import packed

    return packed(token_counts(table(spark, sf, "documents"))).withColumnRenamed("item", "doc_id")


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.packing import fill_report

    return fill_report(p9_pack(spark, sf))


def _p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.readability import language_profile, reading_levels

    documents = table(spark, sf, "documents")
    return reading_levels(documents, profile=language_profile(documents))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.llm.readability import demanding, demanding_from

    threshold = demanding_from(table(spark, sf, "reading_samples"))
    return demanding(_p10_levels(spark, sf), threshold).select("doc_id")


def p10_levels(spark: SparkSession, sf: str) -> DataFrame:
    return _p10_levels(spark, sf)
