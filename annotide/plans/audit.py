"""Audit of the annotated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import audit, labels, overlap
from annotide.operators import tokens as tk
from annotide.plans.common import ROWS, audited, sql_collapse, sql_strip
from annotide.storage import table


def vote_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.vote_summary(audited(spark, sf))


def agreement_by_scope(spark: SparkSession, sf: str) -> DataFrame:
    rows = audited(spark, sf).where("votes is not null")
    return rows.groupBy("eligible", "agreement", "majority", "hard_label").agg(F.count("*").alias("n_rows"))


def row_accounting(spark: SparkSession, sf: str) -> DataFrame:
    return audit.row_accounting(audited(spark, sf))


def soft_targets(spark: SparkSession, sf: str) -> DataFrame:
    return labels.soft_targets(audited(spark, sf))


def text_quality(spark: SparkSession, sf: str) -> DataFrame:
    return audit.text_quality(table(spark, sf, "autalic"))


def length_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.length_summary(audited(spark, sf), 40)


def repeated_targets(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.repeated_targets(audited(spark, sf))


def repeated_triplets(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.repeated_triplets(audited(spark, sf))


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return labels.class_weights(audited(spark, sf).where("eligible and hard_label is not null"))


def label_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean entropy of the soft label by class of agreement."""
    q = F.col("soft_positive")
    h = F.when((q <= 0) | (q >= 1), 0.0).otherwise(-(q * F.log(q) + (1 - q) * F.log(1 - q)))
    return soft_targets(spark, sf).groupBy("agreement_category").agg(F.count("*").alias("n_rows"), F.round(F.avg(h), 6).alias("mean_entropy"))


def weighted_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The probability that a class-weighted soft loss asks for, by soft label."""
    weights = class_weights(spark, sf).first()
    w0, w1 = weights["weight_other"], weights["weight_positive"]
    q = F.col("soft_positive")
    per = soft_targets(spark, sf).groupBy("soft_positive").agg(F.count("*").alias("n_rows"))
    return per.select("soft_positive", "n_rows", F.round(w1 * q / (w0 * (1 - q) + w1 * q), 6).alias("optimum"))


def consistency_antijoins(spark: SparkSession, sf: str) -> DataFrame:
    return audit.consistency(table(spark, sf, "autalic"), table(spark, sf, "split_manifest"), "source_row")


def context_input(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "autalic").select("source_row", tk.context_string().alias("context"))


def target_span(spark: SparkSession, sf: str) -> DataFrame:
    return tk.target_span(table(spark, sf, "autalic")).select("example_id", "start", "stop")


def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The stable id that each record's own fields give: exact hashing in Python batches."""
    from annotide.functions.text import record_digest

    rows = table(spark, sf, "autalic")
    fields = ("preceding", "target", "following", "A1_Score", "A2_Score", "A3_Score")
    return rows.select("source_row", F.format_string("row-%06d-%s", "source_row", F.substring(record_digest(F.struct(*fields)), 1, 12)).alias("record_id"))


def casefold_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Targets whose full case folding differs from lower case."""
    from annotide.functions.text import casefolded

    rows = audited(spark, sf)
    return rows.select("source_row", "norm_target", casefolded("target").alias("folded")).where("norm_target <> folded").select("source_row")


def modeling_rows(spark: SparkSession, sf: str) -> DataFrame:
    return audit.modeling_partition(table(spark, sf, "split_manifest"), table(spark, sf, "targets"), table(spark, sf, "autalic"), "dev_tune").select("example_id", "hard_label", F.length("target").alias("target_chars"))


def selected_source_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of the test partition, and manifest ids without a window, by kind."""
    wanted = table(spark, sf, "split_manifest").where("partition = 'test'").select("example_id").distinct()
    found, missing = audit.selected_rows(table(spark, sf, "autalic"), wanted)
    return found.agg(F.count("*").alias("n")).select(F.lit("found").alias("kind"), "n").union(missing.agg(F.count("*").alias("n")).select(F.lit("missing"), "n"))


def expected_comparison(spark: SparkSession, sf: str) -> DataFrame:
    counts = audited(spark, sf).agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), F.count_if(~F.col("eligible")).alias("excluded"))
    long = counts.unpivot([], ["rows", "eligible", "excluded"], "metric", "value")
    return audit.against_expected(long, {"rows": 3000, "eligible": 2880, "excluded": 120, "unknown": 1})


def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), F.col("text").alias("text"))
    sources = table(spark, sf, "autalic").select(F.col("source_row").alias("row"), F.col("target").alias("target"))
    return audit.leak_scan(docs, "text", sources, "target").select(F.col("output_row").alias("doc_id"), F.col("source_row"))


QUERIES = {f.__name__: f for f in (
    vote_summary, agreement_by_scope, row_accounting, soft_targets, text_quality, length_summary, repeated_targets, repeated_triplets, class_weights, label_entropy, weighted_optimum,
    consistency_antijoins, context_input, target_span, record_ids, casefold_differences, modeling_rows, selected_source_rows, expected_comparison, leak_scan,
)}

_LONG = "SELECT {c}, 'A1_Score' AS annotator, v1 AS label FROM r WHERE ok UNION ALL SELECT {c}, 'A2_Score', v2 FROM r WHERE ok UNION ALL SELECT {c}, 'A3_Score', v3 FROM r WHERE ok"
_SOFT = """SELECT source_row, example_id, n1 AS positive_vote_count, hard AS hard_label, round(n1 / 3::DOUBLE, 12) AS soft_positive, round(1 - n1 / 3::DOUBLE, 12) AS soft_other, round(nm / 3::DOUBLE, 12) AS fraction_minus1,
  round(n0 / 3::DOUBLE, 12) AS fraction_zero, round(n1 / 3::DOUBLE, 12) AS fraction_one, agreement AS agreement_category, nm > 0 AS has_minus1 FROM r WHERE ok"""
_WEIGHTS = "SELECT count(*) AS n, round(count(*) / (2::DOUBLE * nullif(count(*) FILTER (WHERE hard = 0), 0)), 9) AS weight_other, round(count(*) / (2::DOUBLE * nullif(count(*) FILTER (WHERE hard = 1), 0)), 9) AS weight_positive FROM r WHERE eligible AND hard IS NOT NULL"
_CONTEXT = f"list_filter([{sql_collapse('preceding')}, {sql_collapse('target')}, {sql_collapse('following')}], lambda x: x <> '')"
# The literals taken for missing.
_PLACEHOLDERS = "'nan', 'none', 'null', 'na', 'n/a', 'missing'"
_QUALITY = " UNION ALL ".join(
    f"SELECT '{kind}' AS category, '{f}' AS field, count(*) FILTER (WHERE {test.replace('{f}', f)}) AS n_rows FROM autalic"
    for f in ("preceding", "target", "following")
    for kind, test in (("placeholder", f"replace(lower({sql_strip('{f}')}), chr(383), 's') IN ({_PLACEHOLDERS})"), ("replacement_character", "contains({f}, chr(65533))"), ("control_character", r"regexp_matches({f}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')"))
)
SQL = {
    "vote_summary": f"WITH {ROWS}, long AS ({_LONG.format(c='eligible')}), domain AS (SELECT * FROM (VALUES ('raw'), ('eligible'), ('excluded')) s(scope), (VALUES ('all'), ('A1_Score'), ('A2_Score'), ('A3_Score')) a(annotator), (VALUES (-1), (0), (1)) v(label)) "
    "SELECT d.scope, d.annotator, d.label, (SELECT count(*) FROM long l WHERE l.label = d.label AND (d.annotator = 'all' OR d.annotator = l.annotator) AND (d.scope = 'raw' OR (d.scope = 'eligible') = l.eligible)) AS n_votes FROM domain d",
    "agreement_by_scope": f"WITH {ROWS} SELECT eligible, agreement, majority, hard AS hard_label, count(*) AS n_rows FROM r WHERE ok GROUP BY ALL",
    "row_accounting": f"WITH {ROWS} SELECT reason AS exclusion_reason, availability, count(*) AS n_rows FROM r GROUP BY ALL",
    "soft_targets": f"WITH {ROWS} {_SOFT}",
    "text_quality": _QUALITY,
    "length_summary": f"WITH {ROWS}, long AS (SELECT 'preceding' AS field, wp AS w FROM r WHERE eligible UNION ALL SELECT 'target', wt FROM r WHERE eligible UNION ALL SELECT 'following', wf FROM r WHERE eligible UNION ALL SELECT 'combined', wp + wt + wf FROM r WHERE eligible) "
    "SELECT field, count(*) AS n_rows, min(w) AS least, median(w)::DOUBLE AS median, quantile_disc(w, 0.95) AS p95, max(w) AS most, count(*) FILTER (WHERE w > 40) AS n_above FROM long GROUP BY field",
    "repeated_targets": f"WITH {ROWS} SELECT sha256(tn) AS target_sha256, count(*) AS n_rows, (count(DISTINCT coalesce(v1::VARCHAR, '?') || ',' || coalesce(v2::VARCHAR, '?') || ',' || coalesce(v3::VARCHAR, '?')) > 1)::INT AS conflicting FROM r WHERE tn <> '' GROUP BY tn HAVING count(*) > 1",
    "repeated_triplets": f"WITH {ROWS} SELECT sha256(pn || chr(31) || tn || chr(31) || fn) AS triplet_sha256, count(*) AS n_rows FROM r GROUP BY pn, tn, fn HAVING count(*) > 1",
    "class_weights": f"WITH {ROWS} {_WEIGHTS}",
    "label_entropy": f"WITH {ROWS}, s AS ({_SOFT}) SELECT agreement_category, count(*) AS n_rows, round(avg(CASE WHEN soft_positive <= 0 OR soft_positive >= 1 THEN 0 ELSE -(soft_positive * ln(soft_positive) + (1 - soft_positive) * ln(1 - soft_positive)) END), 6) AS mean_entropy FROM s GROUP BY 1",
    "weighted_optimum": f"WITH {ROWS}, s AS ({_SOFT}), w AS ({_WEIGHTS}) SELECT soft_positive, count(*) AS n_rows, round(any_value(weight_positive) * soft_positive / (any_value(weight_other) * (1 - soft_positive) + any_value(weight_positive) * soft_positive), 6) AS optimum FROM s, w GROUP BY soft_positive",
    "consistency_antijoins": """SELECT 'left_only' AS check, (SELECT count(DISTINCT source_row) FROM autalic WHERE source_row NOT IN (SELECT source_row FROM split_manifest)) AS n
UNION ALL SELECT 'right_only', (SELECT count(DISTINCT source_row) FROM split_manifest WHERE source_row NOT IN (SELECT source_row FROM autalic))
UNION ALL SELECT 'left_repeated', (SELECT count(*) FROM (SELECT source_row FROM autalic GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'right_repeated', (SELECT count(*) FROM (SELECT source_row FROM split_manifest GROUP BY 1 HAVING count(*) > 1))""",
    "context_input": f"SELECT source_row, array_to_string({_CONTEXT}, chr(10)) AS context FROM autalic",
    "target_span": f"WITH c AS (SELECT example_id, length({sql_collapse('preceding')}) AS p, length({sql_collapse('target')}) AS t FROM autalic) SELECT example_id, (CASE WHEN p > 0 THEN p + 1 ELSE 0 END)::INT AS start, (CASE WHEN p > 0 THEN p + 1 ELSE 0 END + t)::INT AS stop FROM c",
    "modeling_rows": "SELECT m.example_id, t.hard_label, length(a.target)::INT AS target_chars FROM (SELECT DISTINCT example_id FROM split_manifest WHERE \"partition\" = 'dev_tune') m JOIN (SELECT DISTINCT example_id, hard_label FROM targets) t USING (example_id) JOIN autalic a USING (example_id)",
    "selected_source_rows": "WITH w AS (SELECT DISTINCT example_id FROM split_manifest WHERE \"partition\" = 'test') SELECT 'found' AS kind, (SELECT count(*) FROM autalic WHERE example_id IN (SELECT example_id FROM w)) AS n UNION ALL SELECT 'missing', (SELECT count(*) FROM w WHERE example_id NOT IN (SELECT example_id FROM autalic))",
    "expected_comparison": f"WITH {ROWS}, o AS (SELECT 'rows' AS metric, count(*)::DOUBLE AS v FROM r UNION ALL SELECT 'eligible', count(*) FILTER (WHERE eligible) FROM r UNION ALL SELECT 'excluded', count(*) FILTER (WHERE NOT eligible) FROM r) "
    "SELECT e.metric, o.v AS observed, e.expected::DOUBLE AS expected, coalesce(o.v = e.expected, false) AS matches FROM (VALUES ('rows', 3000), ('eligible', 2880), ('excluded', 120), ('unknown', 1)) e(metric, expected) LEFT JOIN o ON o.metric = e.metric",
    "leak_scan": "SELECT d.doc_id, a.source_row FROM documents d JOIN autalic a ON length(a.target) >= 20 AND contains(d.text, a.target)",
}
