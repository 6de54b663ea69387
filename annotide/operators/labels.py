"""Row-level derivation: votes, agreement, targets, availability, eligibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annotide.functions import text as tx

FIELDS = ("preceding", "target", "following")
SCORES = ("A1_Score", "A2_Score", "A3_Score")
UNANIMOUS, TWO_VS_ONE, ALL_DIFFERENT = "unanimous", "two-versus-one", "all-different"


def parse_vote(score: Column | str) -> Column:
    """-1, 0 or 1 after trimming; null for anything else."""
    text = tx.strip(score)
    return F.when(text.isin("-1", "0", "1"), text.cast("int"))


def vote_violations(df: DataFrame, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """Rows with a score outside the domain, which a strict load refuses."""
    bad = F.lit(False)
    for s in scores:
        bad = bad | parse_vote(s).isNull()
    return df.where(bad)


def votes_of(label: int) -> Column:
    """How many of a row's ``votes`` are ``label``."""
    return F.size(F.filter("votes", lambda v: v == label))


def agreement(votes: Column | str) -> Column:
    """Class of agreement by the number of distinct votes."""
    n = F.size(F.array_distinct(votes))
    return F.when(n == 1, UNANIMOUS).when(n == 2, TWO_VS_ONE).otherwise(ALL_DIFFERENT)


def raw_majority() -> Column:
    """The label of two or more votes, else ``tie``."""
    return F.when(votes_of(-1) >= 2, "-1").when(votes_of(0) >= 2, "0").when(votes_of(1) >= 2, "1").otherwise("tie")


def eligibility_reason() -> Column:
    """Why a row is excluded: all texts empty, or the target; empty for an eligible one."""
    preceding, target, following = (F.length(f"norm_{f}") > 0 for f in FIELDS)
    return F.when(~preceding & ~target & ~following, "all_text_empty").when(~target, "target_empty").otherwise("")


def derive(df: DataFrame) -> DataFrame:
    """Audited rows: ``df`` with normal forms, word counts, availability, votes and labels. Rows without three valid votes have null labels."""
    rows = df.select("*", *(tx.normal(f).alias(f"norm_{f}") for f in FIELDS), *(parse_vote(s).alias(f"v{i + 1}") for i, s in enumerate(SCORES)))
    rows = rows.withColumn("votes", F.when(F.col("v1").isNotNull() & F.col("v2").isNotNull() & F.col("v3").isNotNull(), F.array("v1", "v2", "v3")))
    reason = eligibility_reason()
    return rows.select(
        "*",
        reason.alias("exclusion_reason"),
        (reason == "").alias("eligible"),
        availability_key().alias("availability"),
        *(tx.word_count(F.col(f"norm_{f}")).alias(f"words_{f}") for f in FIELDS),
        F.when(F.col("votes").isNotNull(), agreement("votes")).alias("agreement"),
        F.when(F.col("votes").isNotNull(), raw_majority()).alias("majority"),
        F.when(F.col("votes").isNotNull(), (votes_of(1) >= 2).cast("int")).alias("hard_label"),
    )


def availability_key() -> Column:
    """Which of the texts a row has, as one key."""
    return F.concat_ws("|", *(F.concat(F.lit(f"{f}="), F.when(F.length(f"norm_{f}") > 0, "1").otherwise("0")) for f in FIELDS))


def soft_targets(rows: DataFrame) -> DataFrame:
    """Soft targets and label fractions of rows with three valid votes."""
    third = lambda n: F.round(n / F.lit(3.0), 12)
    positive = votes_of(1)
    return rows.where("votes is not null").select(
        "source_row", "example_id",
        positive.alias("positive_vote_count"),
        (positive >= 2).cast("int").alias("hard_label"),
        third(positive).alias("soft_positive"),
        F.round(1 - positive / F.lit(3.0), 12).alias("soft_other"),
        third(votes_of(-1)).alias("fraction_minus1"),
        third(votes_of(0)).alias("fraction_zero"),
        third(votes_of(1)).alias("fraction_one"),
        agreement("votes").alias("agreement_category"),
        (votes_of(-1) > 0).alias("has_minus1"),
    )


def class_weights(labels: DataFrame, label: str = "hard_label") -> DataFrame:
    """n / (2 * count) of each class of a binary label; null for a class that does not occur."""
    sums = labels.agg(F.count(label).alias("n"), F.sum(label).alias("pos"))
    weight = lambda c: F.when(c > 0, F.round(F.col("n") / (2.0 * c), 9))
    return sums.select(F.col("n").alias("n"), weight(F.col("n") - F.col("pos")).alias("weight_other"), weight(F.col("pos")).alias("weight_positive"))


def votes_long(rows: DataFrame) -> DataFrame:
    """One row a vote: annotator and label, with scope columns of the row."""
    return rows.where("votes is not null").select("eligible", F.expr("stack(3, 'A1_Score', v1, 'A2_Score', v2, 'A3_Score', v3) as (annotator, label)"))


def vote_summary(rows: DataFrame) -> DataFrame:
    """Label counts by scope (raw, eligible, excluded) and annotator, and overall; every label of the domain has a row.

    One pass counts by eligibility, annotator and label; scopes and the overall rows are rolled up from those few rows.
    """
    spark = rows.sparkSession
    counts = votes_long(rows).groupBy("eligible", "annotator", "label").agg(F.count("*").alias("n"))
    scoped = counts.select(F.explode(F.array(F.lit("raw"), F.when(F.col("eligible"), "eligible").otherwise("excluded"))).alias("scope"), "annotator", "label", "n")
    rolled = scoped.select("scope", F.explode(F.array(F.col("annotator"), F.lit("all"))).alias("annotator"), "label", "n").groupBy("scope", "annotator", "label").agg(F.sum("n").alias("n_votes"))
    domain = spark.createDataFrame([(s, a, v) for s in ("raw", "eligible", "excluded") for a in ("all", *SCORES) for v in (-1, 0, 1)], "scope string, annotator string, label int")
    return F.broadcast(domain).join(rolled, ["scope", "annotator", "label"], "left").select("scope", "annotator", "label", F.coalesce("n_votes", F.lit(0)).alias("n_votes"))
