"""Views over the tables that several plans share, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators.labels import derive
from annotide.storage import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_vote(x: str) -> str:
    return f"CASE WHEN {sql_strip(x)} IN ('-1', '0', '1') THEN {sql_strip(x)}::INTEGER END"


def sql_words(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' '))::INTEGER END"


#: r: audited rows. pn, tn, fn are normal forms, wp, wt, wf their words; n1, n0, nm count the votes of a row with three.
ROWS = f"""
src AS (SELECT source_row, example_id, preceding, target, following, lower({sql_collapse('preceding')}) AS pn, lower({sql_collapse('target')}) AS tn, lower({sql_collapse('following')}) AS fn,
  {sql_vote('A1_Score')} AS v1, {sql_vote('A2_Score')} AS v2, {sql_vote('A3_Score')} AS v3 FROM autalic),
counted AS (SELECT *, v1 IS NOT NULL AND v2 IS NOT NULL AND v3 IS NOT NULL AS ok, (v1 = 1)::INT + (v2 = 1)::INT + (v3 = 1)::INT AS n1, (v1 = 0)::INT + (v2 = 0)::INT + (v3 = 0)::INT AS n0, (v1 = -1)::INT + (v2 = -1)::INT + (v3 = -1)::INT AS nm,
  CASE WHEN pn = '' AND tn = '' AND fn = '' THEN 'all_text_empty' WHEN tn = '' THEN 'target_empty' ELSE '' END AS reason FROM src),
r AS (SELECT *, reason = '' AS eligible, {sql_words('pn')} AS wp, {sql_words('tn')} AS wt, {sql_words('fn')} AS wf,
  'preceding=' || (pn <> '')::INT || '|target=' || (tn <> '')::INT || '|following=' || (fn <> '')::INT AS availability,
  CASE WHEN ok THEN CASE (n1 > 0)::INT + (n0 > 0)::INT + (nm > 0)::INT WHEN 1 THEN 'unanimous' WHEN 2 THEN 'two-versus-one' ELSE 'all-different' END END AS agreement,
  CASE WHEN ok THEN CASE WHEN nm >= 2 THEN '-1' WHEN n0 >= 2 THEN '0' WHEN n1 >= 2 THEN '1' ELSE 'tie' END END AS majority,
  CASE WHEN ok THEN (n1 >= 2)::INT END AS hard FROM counted)
"""


def audited(spark: SparkSession, sf: str) -> DataFrame:
    return derive(table(spark, sf, "autalic"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two experiments over the events: a continuous score and one with twenty values."""
    y = (F.col("event_type") == "error").cast("int")
    s1 = (F.col("value") + 1) / (F.col("value") + 51)
    s2 = (F.col("event_id") * 7919 % 20 + 0.5) / 20
    rows = table(spark, sf, "events").select("event_id", "user_id", y.alias("y"), F.array(F.struct(F.lit("S1").alias("experiment"), s1.alias("p")), F.struct(F.lit("S2").alias("experiment"), s2.alias("p"))).alias("x"), "event_type")
    rows = rows.select(F.col("event_id").alias("example_id"), F.col("user_id").alias("group_id"), "event_type", "y", (F.col("event_id") % 4 / 3.0).alias("soft"), F.inline("x"))
    return rows.select("experiment", "example_id", "group_id", "event_type", "y", "soft", "p", (F.col("p") >= 0.5).cast("int").alias("pred"), F.lit(0.0).alias("l0"), F.log(F.col("p") / (1 - F.col("p"))).alias("l1"))


SCORES = """
raw AS (SELECT 'S1' AS experiment, event_id AS example_id, user_id AS group_id, event_type, (event_type = 'error')::INT AS y, (event_id % 4)::DOUBLE / 3 AS soft, (value + 1) / (value + 51) AS p FROM events
  UNION ALL SELECT 'S2', event_id, user_id, event_type, (event_type = 'error')::INT, (event_id % 4)::DOUBLE / 3, ((event_id * 7919) % 20 + 0.5::DOUBLE) / 20 FROM events),
f AS (SELECT *, (p >= 0.5::DOUBLE)::INT AS pred, 0::DOUBLE AS l0, ln(p / (1 - p)) AS l1, greatest(p, 1 - p) AS conf FROM raw WHERE y IS NOT NULL AND p IS NOT NULL)
"""


def bulk_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two experiments over the line items."""
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("group_id"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_linenumber") % 4 / 3.0).alias("soft"),
        F.inline(F.array(F.struct(F.lit("B1").alias("experiment"), (0.0512345 + 8.9123457 * F.col("l_discount")).alias("p")), F.struct(F.lit("B2").alias("experiment"), (0.1034567 + 9.8765432 * F.col("l_tax")).alias("p")))),
    )
    return rows.select("experiment", "group_id", "y", "soft", F.round("p", 6).alias("p"), (F.round("p", 6) >= 0.5).cast("int").alias("pred"))


BULK = """
raw AS (SELECT 'B1' AS experiment, l_orderkey AS group_id, (l_returnflag = 'R')::INT AS y, (l_linenumber % 4)::DOUBLE / 3 AS soft, round(0.0512345::DOUBLE + 8.9123457::DOUBLE * l_discount, 6) AS p FROM lineitem
  UNION ALL SELECT 'B2', l_orderkey, (l_returnflag = 'R')::INT, (l_linenumber % 4)::DOUBLE / 3, round(0.1034567::DOUBLE + 9.8765432::DOUBLE * l_tax, 6) FROM lineitem),
f AS (SELECT *, (p >= 0.5::DOUBLE)::INT AS pred, greatest(p, 1 - p) AS conf FROM raw WHERE y IS NOT NULL AND p IS NOT NULL)
"""
