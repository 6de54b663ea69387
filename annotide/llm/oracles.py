"""DuckDB SQL of the queries that SQL can express on whole tables."""

_KEY = "lower(regexp_replace({x}, '[^\\pL\\pN]', '', 'g'))"
_ID = "nullif(lower(regexp_replace({x}, '^\\s+|\\s+$', '', 'g')), '')"

_COPIES = f"""
fields AS (SELECT source_row, target, list_filter(regexp_split_to_array(target, '[;|\\n\\r\\v\\f\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_matches(x, '[^\\s]')) AS f FROM autalic WHERE regexp_matches(target, '[^\\s\\x{{a0}}\\x{{2009}}]')),
keyed AS (SELECT source_row, CASE WHEN len(f) >= 3 AND len(list_filter(f, lambda x: regexp_matches(x, '(?s)^[^:]*[\\pL\\pN][^:]*:.*[\\pL\\pN]'))) = len(f)
  THEN array_to_string(list_sort(list_transform(f, lambda x: {_KEY.format(x="x")})), chr(10)) ELSE {_KEY.format(x="target")} END AS key FROM fields),
sets AS (SELECT key, min(source_row) AS first, count(*) AS n_copies FROM keyed GROUP BY key)"""

_REACH = """both_ AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT DISTINCT a AS id, a AS root FROM both_ UNION SELECT e.b, x.root FROM reach x JOIN both_ e ON e.a = x.id),
comp AS (SELECT id, min(root) AS root FROM reach GROUP BY id)"""

_SPREAD = f"""related AS (SELECT DISTINCT source_row, {_ID.format(x="group_id")} AS id FROM split_manifest UNION SELECT DISTINCT source_row, {_ID.format(x="rule_b_group_id")} FROM targets),
edges AS (SELECT 'r' || source_row AS a, 'g' || id AS b FROM related WHERE id IS NOT NULL),
{_REACH},
spread AS (SELECT root FROM comp JOIN split_manifest m ON id = 'r' || m.source_row GROUP BY root HAVING count(DISTINCT "partition") > 1)"""

_PAIRS = """side AS (SELECT DISTINCT source_row, "partition" = 'train' AS train FROM split_manifest), t AS (SELECT source_row, train, unnest(regexp_extract_all(lower(target), '[\\pL\\pN]+')) AS w FROM autalic JOIN side USING (source_row)),
o AS (SELECT source_row, train, w, row_number() OVER (PARTITION BY source_row, w) AS k, count(*) OVER (PARTITION BY source_row) AS n FROM t)
SELECT least(a.source_row, b.source_row) AS source_row_1, greatest(a.source_row, b.source_row) AS source_row_2 FROM o a JOIN o b ON a.w = b.w AND a.k = b.k AND a.train AND NOT b.train AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
GROUP BY a.source_row, b.source_row, a.n, b.n HAVING 5 * count(*) >= 4 * greatest(a.n, b.n)"""

_GRAMS = """long AS (SELECT source_row, unnest([1, 2, 3]) AS field, unnest([preceding, target, following]) AS t FROM autalic),
g AS (SELECT source_row, field, i, substr(t, i::INT, 160) AS s FROM (SELECT source_row, field, t, unnest(range(1, length(t) - 158)) AS i FROM long WHERE length(t) >= 160))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_PAIRS}",
    "p1_report": f"""WITH found AS (WITH {_PAIRS}),
held AS (SELECT DISTINCT source_row, "partition" FROM split_manifest WHERE "partition" <> 'train'),
hit AS (SELECT DISTINCT source_row FROM held SEMI JOIN (SELECT source_row_1 AS source_row FROM found UNION SELECT source_row_2 FROM found) USING (source_row))
SELECT "partition", lower(trim(source)) AS source, count(*) AS n_windows, count(h.source_row) AS n_overlapping, round(count(h.source_row) / count(*), 6) AS share
FROM held LEFT JOIN autalic USING (source_row) LEFT JOIN hit h USING (source_row) GROUP BY ALL""",
    "p2_found": f"WITH {_COPIES} SELECT first AS source_row_1, source_row AS source_row_2 FROM keyed JOIN sets USING (key) WHERE source_row <> first",
    "p2_records": f"WITH {_COPIES} SELECT first AS source_row, n_copies FROM sets",
    "p3_found": f"""WITH {_GRAMS}
SELECT DISTINCT a.source_row AS source_row_1, b.source_row AS source_row_2 FROM g a JOIN g b ON a.s = b.s AND a.source_row < b.source_row""",
    "p3_share": f"""WITH {_GRAMS}, shared AS (SELECT s FROM g GROUP BY s HAVING count(DISTINCT source_row) > 1),
starts AS (SELECT source_row, field, i, lag(i) OVER (PARTITION BY source_row, field ORDER BY i) AS before FROM g SEMI JOIN shared USING (s)),
covered AS (SELECT source_row, sum(least(160, i - coalesce(before, i - 160)))::BIGINT AS n_shared FROM starts GROUP BY 1),
sizes AS (SELECT source_row, coalesce(length(preceding), 0) + coalesce(length(target), 0) + coalesce(length(following), 0) AS n_chars FROM autalic)
SELECT source_row, n_chars, coalesce(n_shared, 0) AS n_shared, CASE WHEN n_chars > 0 THEN round(coalesce(n_shared, 0) / n_chars, 6) END AS share FROM sizes LEFT JOIN covered USING (source_row)""",
    "p4_found": f"WITH RECURSIVE {_SPREAD} SELECT DISTINCT m.source_row FROM split_manifest m JOIN comp ON id = 'r' || m.source_row JOIN spread USING (root)",
    "p4_splits": f"""WITH RECURSIVE {_SPREAD}, named AS (SELECT root, min(substr(id, 2)) FILTER (WHERE id[1] = 'g') AS component FROM comp GROUP BY root),
m AS (SELECT DISTINCT source_row, "partition" FROM split_manifest)
SELECT source_row, coalesce(component, ' row:' || source_row) AS component, CASE WHEN s.root IS NULL THEN 'kept' ELSE 'quarantined' END AS status, CASE WHEN s.root IS NULL THEN "partition" END AS split
FROM m LEFT JOIN comp ON id = 'r' || source_row LEFT JOIN named n USING (root) LEFT JOIN spread s USING (root)""",
    "p4_balance": "SELECT * FROM (VALUES ('train', 0.7::DOUBLE, 0::BIGINT), ('dev_tune', 0.075, 0), ('dev_calibration', 0.075, 0), ('test', 0.15, 0)) AS t(split, wanted, n_spread)",
    "p5_agreement": """WITH v AS (SELECT DISTINCT vote_id, example_id, regexp_replace(label, '^\\s+|\\s+$', '', 'g') AS l FROM annotation_votes), u AS (SELECT example_id, count(*) AS m, count(*) FILTER (WHERE l = '-1') AS a, count(*) FILTER (WHERE l = '0') AS b, count(*) FILTER (WHERE l = '1') AS c FROM v WHERE l IN ('-1', '0', '1') GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT count(*) AS units, sum(m)::BIGINT AS votes, sum((m * m - a * a - b * b - c * c) / (m - 1)) AS observed, sum(a) AS sa, sum(b) AS sb, sum(c) AS sc FROM u) SELECT units, votes, round(1 - observed / ((votes::DOUBLE * votes - sa * sa - sb * sb - sc * sc) / (votes - 1)), 6) AS alpha FROM s""",
    "p6_found": f"""WITH RECURSIVE pairs AS (SELECT {_ID.format(x="example_id_1")} AS a, {_ID.format(x="example_id_2")} AS b FROM overlap_links),
named AS (SELECT {_ID.format(x="example_id")} AS a, {_ID.format(x="g")} AS b FROM (SELECT example_id, unnest(string_split(rule_b_group_ids, '|')) AS g FROM group_membership)),
edges AS (SELECT 'r' || a AS a, 'r' || b AS b FROM pairs WHERE a <> b UNION SELECT 'r' || a, 'g' || b FROM named WHERE a IS NOT NULL AND b IS NOT NULL),
{_REACH},
rec AS (SELECT substr(id, 2) AS id, root FROM comp WHERE id[1] = 'r'), grp AS (SELECT root, min(id) AS first FROM rec GROUP BY root HAVING count(*) > 1)
SELECT first AS group_example_id, id AS example_id FROM rec JOIN grp USING (root)""",
}
