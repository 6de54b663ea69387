"""Incremental counts of votes as they arrive: an extension, as the batch pipeline has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annotide.operators.labels import parse_vote


def hourly_votes(votes: DataFrame, late: str = "2 days") -> DataFrame:
    """start, annotator_id, label, n of valid votes by the hour in which they were cast.

    Works on a stream and on a table alike. A vote_id counts once within the watermark; votes later than that are
    dropped by the stream, as its state is bounded by it.
    """
    valid = votes.select("vote_id", "annotator_id", "voted_at", parse_vote("label").alias("label")).where("label is not null")
    once = valid.withWatermark("voted_at", late).dropDuplicatesWithinWatermark(["vote_id"]) if votes.isStreaming else valid.dropDuplicates(["vote_id"])
    counts = once.groupBy(F.window("voted_at", "1 hour"), "annotator_id", "label").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "annotator_id", "label", "n")
