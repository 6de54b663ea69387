"""Votes by the hour, as the streaming operator counts them on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annotide.storage import table
from annotide.streaming.votes import hourly_votes as count_votes


def hourly_votes(spark: SparkSession, sf: str) -> DataFrame:
    return count_votes(table(spark, sf, "annotation_votes"))


QUERIES = {"hourly_votes": hourly_votes}
SQL = {
    "hourly_votes": r"WITH v AS (SELECT DISTINCT vote_id, annotator_id, voted_at, regexp_replace(label, '^\s+|\s+$', '', 'g')::INT AS label FROM annotation_votes) SELECT date_trunc('hour', voted_at)::TIMESTAMP AS start, annotator_id, label, count(*) AS n FROM v GROUP BY ALL"
}
