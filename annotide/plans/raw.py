"""Loading of undigested CSV records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annotide.sources.raw_records import failed_records, loaded_records, parsed_records
from annotide.storage import table


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return failed_records(parsed_records(table(spark, sf, "autalic_raw"))).select("raw_id", "reason")


def p7_edits(spark: SparkSession, sf: str) -> DataFrame:
    return failed_records(parsed_records(table(spark, sf, "autalic_raw")))


def p7_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return loaded_records(parsed_records(table(spark, sf, "autalic_raw")))


QUERIES = {"p7_found": p7_found, "p7_edits": p7_edits, "p7_loaded": p7_loaded}

_FIELD = r'("([^"]|"")*"|[^",]*)'
_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Fields are taken off the front one by one; the seventh column is what is left over after six.
_PARSED = f"""
WITH quoted AS (SELECT raw_id, raw_text, regexp_full_match(raw_text, '(?s){_FIELD}(,{_FIELD})*') AS fine FROM autalic_raw),
six AS (SELECT raw_id, raw_text, fine, regexp_full_match(raw_text, '(?s){_FIELD}(,{_FIELD}){{5}}') AS columns_fine,
  regexp_extract(raw_text, '(?s)^{_FIELD},({_FIELD}),{_FIELD},({_FIELD}),({_FIELD}),({_FIELD})$', ['f1', 'f2', 'target', 'f4', 'f5', 'f6', 'f7', 's1', 'f9', 'f10', 's2', 'f12', 'f13', 's3', 'f15', 'f16']) AS x FROM quoted),
bare AS (SELECT raw_id, fine, columns_fine,
  [regexp_replace(CASE WHEN s[1] = '"' THEN s[2:-2] ELSE s END, '^{_SPACE}+|{_SPACE}+$', '', 'g') FOR s IN [x.s1, x.s2, x.s3]] AS scores,
  regexp_replace(CASE WHEN x.target[1] = '"' THEN x.target[2:-2] ELSE x.target END, '{_SPACE}', '', 'g') AS target FROM six)
"""
SQL = {
    "p7_found": _PARSED
    + """
SELECT raw_id, CASE WHEN NOT fine THEN 'quoting' WHEN NOT columns_fine THEN 'column_count'
  WHEN NOT (scores[1] IN ('-1', '0', '1') AND scores[2] IN ('-1', '0', '1') AND scores[3] IN ('-1', '0', '1')) THEN 'score_value' ELSE 'target_empty' END AS reason
FROM bare WHERE NOT fine OR NOT columns_fine OR NOT (scores[1] IN ('-1', '0', '1') AND scores[2] IN ('-1', '0', '1') AND scores[3] IN ('-1', '0', '1')) OR target = ''
"""
}
