"""Token budgets of the annotated windows, with one token a word."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annotide.operators import tokens as tk
from annotide.plans.common import sql_collapse
from annotide.storage import table

LIMIT = 64


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return tk.assembled(table(spark, sf, "autalic"), LIMIT)


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    from annotide.functions import text as tx

    parts = table(spark, sf, "split_manifest").select("example_id", "partition").distinct()
    rows = table(spark, sf, "autalic").select("example_id", *(tx.word_count(tx.collapse(f)).alias(f"n_{f}") for f in ("preceding", "target", "following")))
    return rows.join(parts, "example_id")


def token_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("example_id", "mode", "n_preceding", "n_target", "n_following", "n_input", "kept_preceding", "kept_following", F.array_join("input_ids", " ").alias("ids"))


def token_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of each sequence and its padded length within its mode."""
    rows = _encoded(spark, sf)
    most = rows.groupBy("mode").agg(F.max("n_input").alias("most"))
    return rows.join(F.broadcast(most), "mode").select("example_id", "mode", "input_sha256", F.size(tk.padded(F.col("input_ids"), F.col("most"))).alias("n_padded"))


def token_length_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = tk.length_summary(_lengths(spark, sf), (16, 32, 64))
    return s.select("partition", "field", "n_rows", "least", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"), "most", "above_16", "above_32", "above_64")


def truncation_effect(spark: SparkSession, sf: str) -> DataFrame:
    return tk.truncation_effect(_lengths(spark, sf))


def truncation_audit(spark: SparkSession, sf: str) -> DataFrame:
    return tk.truncation_audit(_encoded(spark, sf), LIMIT)


def target_words_in_span(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of a window's context share a character with its target."""
    spans = tk.target_span(table(spark, sf, "autalic"))
    return spans.select("example_id", F.size(tk.words_within("context", "start", "stop")).alias("n_words"))


QUERIES = {f.__name__: f for f in (token_truncation, token_sequences, token_length_summary, truncation_effect, truncation_audit, target_words_in_span)}

_WORDS = ", ".join(f"list_filter(string_split({sql_collapse(f)}, ' '), lambda x: x <> '') AS {f[0]}" for f in ("preceding", "target", "following"))
_FIXED = 2 + sum(len(m) for m in tk.MARKERS.values())
_ROOM = LIMIT - _FIXED


def _list(values: tuple[int, ...]) -> str:
    return "[" + ", ".join(map(str, values)) + "]"


def _cut(ids: str, budget: int) -> str:
    tail = (budget - 2) // 2
    head = budget - 2 - tail
    return f"CASE WHEN len({ids}) <= {budget} THEN {ids} ELSE {ids}[1:{head}] || {_list(tk.ELLIPSIS)} || {ids}[len({ids}) - {tail} + 1:] END"


_ENCODED = f"""w AS (SELECT example_id, {_WORDS} FROM autalic),
i AS (SELECT example_id, list_transform(range(len(p)), lambda k: k + 200)::INTEGER[] AS p, list_transform(range(len(t)), lambda k: k + 200)::INTEGER[] AS t, list_transform(range(len(f)), lambda k: k + 200)::INTEGER[] AS f FROM w),
k AS (SELECT *, {_cut('t', _ROOM)} AS kt, {_cut('t', LIMIT - 2)} AS alone FROM i),
b AS (SELECT *, greatest({_ROOM} - len(kt), 0) AS room FROM k),
h AS (SELECT *, room // 2 AS ha, room - room // 2 AS hb FROM b),
a AS (SELECT *, least(len(p), least(len(p), hb) + (ha - least(len(f), ha))) AS np FROM h),
g AS (SELECT *, least(len(f), room - np) AS nf FROM a),
enc AS (SELECT example_id, 'target_only' AS mode, len(p) AS lp, len(t) AS lt, len(f) AS lf, [{tk.BOS}] || alone || [{tk.EOS}] AS ids, 0 AS np, 0 AS nf FROM g UNION ALL
 SELECT example_id, 'context', len(p), len(t), len(f), [{tk.BOS}] || {_list(tk.MARKERS['preceding'])} || CASE WHEN np > 0 THEN p[len(p) - np + 1:] ELSE [] END || {_list(tk.MARKERS['target'])} || kt || {_list(tk.MARKERS['following'])} || CASE WHEN nf > 0 THEN f[1:nf] ELSE [] END || [{tk.EOS}], np, nf FROM g)"""
_LENGTHS = f"w AS (SELECT example_id, {_WORDS} FROM autalic), l AS (SELECT m.part, len(p) AS lp, len(t) AS lt, len(f) AS lf FROM w JOIN (SELECT DISTINCT example_id, \"partition\" AS part FROM split_manifest) m USING (example_id))"
_LONG = "long AS (SELECT part, 'preceding' AS field, lp AS n FROM l UNION ALL SELECT part, 'target', lt FROM l UNION ALL SELECT part, 'following', lf FROM l)"
_PREFIXES = {"preceding": ("0", "lp"), "target": ("lp", "lp + lt"), "following": ("lp + lt", "lp + lt + lf")}
SQL = {
    "token_truncation": f"WITH {_ENCODED} SELECT example_id, mode, lp::INT AS n_preceding, lt::INT AS n_target, lf::INT AS n_following, len(ids)::INT AS n_input, np::INT AS kept_preceding, nf::INT AS kept_following, array_to_string(ids, ' ') AS ids FROM enc",
    "token_sequences": f"WITH {_ENCODED} SELECT example_id, mode, sha256('[' || array_to_string(ids, ',') || ']') AS input_sha256, (max(len(ids)) OVER (PARTITION BY mode))::INT AS n_padded FROM enc",
    "token_length_summary": f"""WITH {_LENGTHS}, {_LONG}, both_ AS (SELECT part, field, n FROM long UNION ALL SELECT 'all', field, n FROM long) SELECT part AS "partition", field, count(*) AS n_rows, min(n)::INT AS least, round(quantile_cont(n::DOUBLE, 0.5), 6) AS median,
 round(quantile_cont(n::DOUBLE, 0.95), 6) AS p95, max(n)::INT AS most, count(*) FILTER (WHERE n > 16) AS above_16, count(*) FILTER (WHERE n > 32) AS above_32, count(*) FILTER (WHERE n > 64) AS above_64 FROM both_ GROUP BY ALL""",
    "truncation_effect": f"WITH {_LENGTHS}, c AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {m} AS max_tokens, greatest(0, least({b}, {m}) - ({a})) AS kept, ({b}) - ({a}) AS total FROM l" for f, (a, b) in _PREFIXES.items() for m in (16, 32, 64))
    + ") SELECT field, max_tokens, count(*) FILTER (WHERE kept = total) AS n_full, count(*) FILTER (WHERE kept > 0 AND kept < total) AS n_partial, count(*) FILTER (WHERE kept = 0) AS n_lost FROM c WHERE total > 0 GROUP BY ALL",
    "truncation_audit": f"""WITH {_ENCODED} SELECT mode, count(*) AS n_rows, count(*) FILTER (WHERE len(ids) = {LIMIT}) AS n_at_limit, count(*) FILTER (WHERE np < lp AND np > 0) AS preceding_partial, count(*) FILTER (WHERE np = 0 AND lp > 0) AS preceding_lost,
 count(*) FILTER (WHERE nf < lf AND nf > 0) AS following_partial, count(*) FILTER (WHERE nf = 0 AND lf > 0) AS following_lost FROM enc WHERE mode = 'context' GROUP BY mode""",
    "target_words_in_span": f"WITH w AS (SELECT example_id, {_WORDS} FROM autalic) SELECT example_id, len(t)::INT AS n_words FROM w",
}
