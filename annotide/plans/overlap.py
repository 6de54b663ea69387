"""Exact text reuse among the annotated windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import overlap
from annotide.plans.common import ROWS, audited
from annotide.storage import Scratch, table


def _eligible(spark: SparkSession, sf: str) -> DataFrame:
    return audited(spark, sf).where("eligible")


def _index(spark: SparkSession, sf: str, scratch: Scratch | None = None) -> DataFrame:
    """The index, written once, as groups read it several times."""
    found = overlap.inverted_index(_eligible(spark, sf))
    return (scratch or Scratch(spark, "overlap")).write(found, "index")


def _written(rows: DataFrame, index: DataFrame, *rules: str) -> list[DataFrame]:
    """The groupings by some rules, written, as comparisons read them several times."""
    scratch = Scratch(rows.sparkSession, "groupings")
    return [scratch.write(overlap.groups(rows, index, rule), rule) for rule in rules]


def overlap_index(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.inverted_index(_eligible(spark, sf)).select("setting", overlap.hexed("value").alias("value_sha256"), "example_id", "field", "words")


def overlap_links(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_links(overlap.inverted_index(_eligible(spark, sf)))


def overlap_classes(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.value_classes(overlap.inverted_index(_eligible(spark, sf)))


def shared_string_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.shared_rollup(overlap.inverted_index(_eligible(spark, sf)))


def _groups(rule: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return overlap.groups(_eligible(spark, sf), _index(spark, sf), rule)

    return run


def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _eligible(spark, sf), _index(spark, sf)
    out = None
    for rule in ("five", "a", "b"):
        one = overlap.group_statistics(overlap.groups(rows, index, rule), rows).select(F.lit(rule).alias("rule"), "*")
        out = one if out is None else out.union(one)
    return out


def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.size_histogram(overlap.groups(_eligible(spark, sf), _index(spark, sf), "b"))


def rule_containment(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _eligible(spark, sf), _index(spark, sf)
    return overlap.grouping_checks(rows, index, *_written(rows, index, "a", "b"))


def rule_merges(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _eligible(spark, sf), _index(spark, sf)
    return overlap.merges(*_written(rows, index, "a", "b")).select("n_merged", "size")


def rule_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _eligible(spark, sf), _index(spark, sf)
    return overlap.rule_comparison(index, *_written(rows, index, "five", "a", "b"))


def group_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = _eligible(spark, sf).where("votes is not null")
    return overlap.group_summary(overlap.groups(_eligible(spark, sf), _index(spark, sf), "b"), rows, "b")


def link_categories(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.link_categories(overlap.inverted_index(_eligible(spark, sf)))


def review_shortlist(spark: SparkSession, sf: str) -> DataFrame:
    rows, index = _eligible(spark, sf), _index(spark, sf)
    merging = overlap.short_merges(index, overlap.groups(rows, index, "a"))
    return overlap.review_shortlist(overlap.link_categories(index), merging)


def leakage_check(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.leakage(overlap.inverted_index(_eligible(spark, sf)), table(spark, sf, "split_manifest"))


QUERIES = {f.__name__: f for f in (overlap_index, overlap_links, overlap_classes, shared_string_rollup, group_stats, group_sizes, rule_containment, rule_merges, rule_comparison, group_summary, link_categories, review_shortlist, leakage_check)} | {
    f"components_rule_{rule}": _groups(rule) for rule in ("five", "a", "b")
}

_INDEX = f"""{ROWS}, e AS (SELECT * FROM r WHERE eligible),
long AS (SELECT example_id, 'preceding' AS field, preceding AS t, pn AS n, wp AS words FROM e UNION ALL SELECT example_id, 'target', target, tn, wt FROM e UNION ALL SELECT example_id, 'following', following, fn, wf FROM e),
idx AS (SELECT DISTINCT 'original' AS setting, t AS value, example_id, field, words FROM long WHERE n <> '' UNION ALL SELECT DISTINCT 'whitespace_casefold', n, example_id, field, words FROM long WHERE n <> '')"""
_LINKS = f"""{_INDEX}, links AS (SELECT DISTINCT a.setting AS comparison_setting, a.example_id AS example_id_1, a.field AS field_1, b.example_id AS example_id_2, b.field AS field_2, sha256(a.value) AS normalized_text_sha256, a.words AS word_count,
  CASE WHEN a.field = 'target' AND b.field = 'target' THEN 'target_target' WHEN a.field = 'target' OR b.field = 'target' THEN 'target_context' ELSE 'context_context' END || CASE WHEN a.setting = 'whitespace_casefold' AND a.words >= 5 THEN '_substantial' ELSE '_short_or_unthresholded' END AS link_type
  FROM idx a JOIN idx b ON a.setting = b.setting AND a.value = b.value AND a.example_id < b.example_id)"""
_CATEGORIES = f"""{_LINKS}, cat AS (SELECT normalized_text_sha256, max(word_count) AS word_count, count(*) AS n_links, max((link_type LIKE 'target_target%')::INT) AS has_target_target, max((link_type LIKE 'target_context%')::INT) AS has_target_context,
  max((link_type LIKE 'context_context%')::INT) AS has_context_context FROM links WHERE comparison_setting = 'whitespace_casefold' GROUP BY 1)"""


def _sql_groups(rules: tuple[str, ...]) -> str:
    """CTEs that end in g_<rule>(example_id, group_id) for each rule."""
    wheres = {"five": "words >= 5", "a": "words >= 5 OR field = 'target'", "b": "true"}
    out = "RECURSIVE " + _INDEX
    for k in rules:
        stars = [f"SELECT value, min(example_id) AS first FROM idx WHERE setting = 'whitespace_casefold' AND ({w}) GROUP BY value HAVING count(DISTINCT example_id) > 1" for w in (("words >= 5", "field = 'target'") if k == "a" else (wheres[k],))]
        picks = ("words >= 5", "field = 'target'") if k == "a" else (wheres[k],)
        edges = " UNION ".join(f"SELECT DISTINCT i.example_id AS a, s.first AS b FROM idx i JOIN ({star}) s USING (value) WHERE i.setting = 'whitespace_casefold' AND ({w})" for star, w in zip(stars, picks, strict=True))
        out += f""", st_{k} AS ({edges}), ed_{k} AS (SELECT a, b FROM st_{k} UNION SELECT b, a FROM st_{k}),
reach_{k} AS (SELECT DISTINCT a AS id, a AS root FROM ed_{k} UNION SELECT e.b, x.root FROM reach_{k} x JOIN ed_{k} e ON e.a = x.id),
root_{k} AS (SELECT id, min(root) AS root FROM reach_{k} GROUP BY id),
mem_{k} AS (SELECT e.example_id, coalesce(root, e.example_id) AS root FROM (SELECT DISTINCT example_id FROM e) e LEFT JOIN root_{k} ON id = e.example_id),
gid_{k} AS (SELECT root, '{ {'five': 'five-', 'a': 'rule-a-', 'b': 'rule-b-'}[k] }' || substr(sha256(string_agg(example_id, '|' ORDER BY example_id)), 1, 16) AS group_id FROM mem_{k} GROUP BY root),
g_{k} AS (SELECT example_id, group_id FROM mem_{k} JOIN gid_{k} USING (root))"""
    return out


def _sql_stats(k: str) -> str:
    return f"SELECT '{k}' AS rule, count(*) AS n_groups, count(*) FILTER (WHERE size = 1) AS n_singletons, count(*) FILTER (WHERE size > 1) AS n_nontrivial, coalesce(sum(size) FILTER (WHERE size > 1), 0)::BIGINT AS n_in_nontrivial, max(size) AS largest, count(*) FILTER (WHERE pos > 0) AS n_with_positive FROM (SELECT group_id, count(*) AS size, coalesce(sum(hard), 0) AS pos FROM g_{k} JOIN e USING (example_id) GROUP BY 1)"


SQL = {
    "overlap_index": f"WITH {_INDEX} SELECT setting, sha256(value) AS value_sha256, example_id, field, words FROM idx",
    "overlap_links": f"WITH {_LINKS} SELECT * FROM links",
    "overlap_classes": f"WITH {_INDEX}, s AS (SELECT setting, value, min(example_id) AS first_id FROM idx GROUP BY 1, 2 HAVING count(DISTINCT example_id) > 1) SELECT setting, sha256(value) AS class_id, first_id, example_id, field, words FROM idx JOIN s USING (setting, value)",
    "shared_string_rollup": f"""WITH {_INDEX}, s AS (SELECT setting, value, max(words) AS words FROM idx GROUP BY 1, 2 HAVING count(DISTINCT example_id) > 1), h AS (SELECT idx.* FROM idx JOIN s USING (setting, value))
SELECT setting, (SELECT count(*) FROM s WHERE s.setting = h.setting) AS n_shared, (SELECT count(*) FROM s WHERE s.setting = h.setting AND words >= 5) AS n_substantial, count(DISTINCT example_id) AS n_examples,
 count(DISTINCT example_id) FILTER (WHERE field = 'target' AND EXISTS (SELECT 1 FROM h o WHERE o.setting = h.setting AND o.value = h.value AND o.field <> 'target' AND o.example_id <> h.example_id)) AS n_target_elsewhere FROM h GROUP BY setting""",
    "link_categories": f"WITH {_CATEGORIES} SELECT * FROM cat",
    "review_shortlist": f"""WITH {_sql_groups(('a',))}, {_CATEGORIES.removeprefix(_INDEX).lstrip(', ')},
st AS (SELECT *, concat_ws('+', CASE WHEN has_target_target = 1 THEN 'tt' END, CASE WHEN has_target_context = 1 THEN 'tc' END, CASE WHEN has_context_context = 1 THEN 'cc' END) AS stratum FROM cat),
short AS (SELECT sha256(value) AS h FROM idx JOIN g_a USING (example_id) WHERE setting = 'whitespace_casefold' AND words < 5 GROUP BY value HAVING count(DISTINCT group_id) > 1)
SELECT stratum, normalized_text_sha256, word_count, n_links FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY normalized_text_sha256) AS k FROM st WHERE word_count >= 5) WHERE k <= 1
UNION ALL SELECT * FROM (SELECT 'short', normalized_text_sha256, word_count, n_links FROM cat WHERE normalized_text_sha256 IN (SELECT h FROM short) ORDER BY word_count DESC, normalized_text_sha256 LIMIT 4)""",
    "leakage_check": f"""WITH {_INDEX}, m AS (SELECT DISTINCT example_id, "partition" AS part FROM split_manifest) SELECT sha256(value) AS value_sha256, max(words) AS words, count(DISTINCT part) AS n_partitions, count(DISTINCT example_id) AS n_examples
FROM idx JOIN m USING (example_id) WHERE setting = 'whitespace_casefold' GROUP BY value HAVING count(DISTINCT part) > 1""",
    "group_stats": f"WITH {_sql_groups(('five', 'a', 'b'))} " + " UNION ALL ".join(map(_sql_stats, ("five", "a", "b"))),
    "group_sizes": f"WITH {_sql_groups(('b',))} SELECT size, count(*) AS n_groups FROM (SELECT group_id, count(*) AS size FROM g_b GROUP BY 1) GROUP BY size",
    "rule_containment": f"""WITH {_sql_groups(('a', 'b'))}, norm AS (SELECT * FROM idx WHERE setting = 'whitespace_casefold')
""" + "UNION ALL ".join(
        f"""SELECT 'rule_{k}_members' AS check, (SELECT count(*) FROM (SELECT example_id FROM e EXCEPT SELECT example_id FROM g_{k})) + (SELECT count(*) FROM (SELECT example_id FROM g_{k} EXCEPT SELECT example_id FROM e)) AS n_violations
UNION ALL SELECT 'rule_{k}_repeated_targets', (SELECT count(*) FROM (SELECT value FROM norm JOIN g_{k} USING (example_id) WHERE field = 'target' GROUP BY 1 HAVING count(DISTINCT group_id) > 1))
UNION ALL SELECT 'rule_{k}_long_texts', (SELECT count(*) FROM (SELECT value FROM norm JOIN g_{k} USING (example_id) WHERE words >= 5 GROUP BY 1 HAVING count(DISTINCT group_id) > 1))
"""
        for k in ("a", "b")
    ) + "UNION ALL SELECT 'rule_a_within_rule_b', (SELECT count(*) FROM (SELECT a.group_id FROM g_a a JOIN g_b b USING (example_id) GROUP BY 1 HAVING count(DISTINCT b.group_id) > 1))",
    "rule_merges": f"WITH {_sql_groups(('a', 'b'))} SELECT count(DISTINCT a.group_id) AS n_merged, count(*) AS size FROM g_b b JOIN g_a a USING (example_id) GROUP BY b.group_id HAVING count(DISTINCT a.group_id) > 1",
    "rule_comparison": f"""WITH {_sql_groups(('five', 'a', 'b'))}, norm AS (SELECT * FROM idx WHERE setting = 'whitespace_casefold'),
m AS (SELECT b.group_id, count(*) AS size FROM g_b b JOIN g_a a USING (example_id) GROUP BY 1 HAVING count(DISTINCT a.group_id) > 1),
short AS (SELECT value FROM norm JOIN g_a USING (example_id) WHERE words < 5 GROUP BY 1 HAVING count(DISTINCT group_id) > 1),
rep AS (SELECT value, count(DISTINCT group_id) AS n_groups FROM norm JOIN g_five USING (example_id) WHERE field = 'target' GROUP BY 1 HAVING count(DISTINCT group_id) > 1)
SELECT 'rule_b_groups_that_merge' AS measure, (SELECT count(*) FROM m) AS n UNION ALL SELECT 'examples_in_them', (SELECT coalesce(sum(size), 0)::BIGINT FROM m)
UNION ALL SELECT 'short_texts_that_merge', (SELECT count(*) FROM short) UNION ALL SELECT 'repeated_targets_that_merge', (SELECT count(*) FROM rep)
UNION ALL SELECT 'five_word_groups_merged', (SELECT coalesce(sum(n_groups - 1), 0)::BIGINT FROM rep)
UNION ALL SELECT 'examples_of_repeated_targets', (SELECT count(DISTINCT example_id) FROM norm JOIN rep USING (value) WHERE field = 'target')""",
    "group_summary": f"""WITH {_sql_groups(('b',))} SELECT 'b' AS rule, group_id, count(*) AS size, count(*) FILTER (WHERE hard = 1) AS positive, count(*) FILTER (WHERE hard = 0) AS other, sum(nm)::BIGINT AS votes_minus1, sum(n0)::BIGINT AS votes_zero, sum(n1)::BIGINT AS votes_one,
 count(*) FILTER (WHERE agreement = 'unanimous') AS unanimous, count(*) FILTER (WHERE agreement = 'two-versus-one') AS two_versus_one, count(*) FILTER (WHERE agreement = 'all-different') AS all_different FROM g_b JOIN e USING (example_id) WHERE ok GROUP BY group_id""",
} | {f"components_rule_{k}": f"WITH {_sql_groups((k,))} SELECT example_id, group_id FROM g_{k}" for k in ("five", "a", "b")}
