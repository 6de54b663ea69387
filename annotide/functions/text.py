"""Text functions as native columns, and the exact ones that need Python."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Every character that Python's str.strip() and str.split() take for whitespace.
WHITESPACE = "".join(map(chr, (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: The same as a Java character class.
BLANKS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(text: Column | str) -> Column:
    """Without Unicode whitespace at either end."""
    return F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(WHITESPACE))


def identifier(text: Column | str) -> Column:
    """A trimmed id in lower case; null if there is none."""
    return F.nullif(F.lower(strip(text)), F.lit(""))


def collapse(text: Column | str) -> Column:
    """Each run of whitespace as one space, none at the ends; null as the empty text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    odd = F.rlike(text, F.lit(BLANKS.replace("\\x20", "\\x1f") + "|  "))  # most texts have single spaces only
    return F.trim(F.when(odd, F.regexp_replace(text, BLANKS + "+", " ")).otherwise(text))


def normal(text: Column | str) -> Column:
    """Collapsed and in lower case, inside the JVM; ``casefolded`` is the exact form for all of Unicode."""
    return F.lower(collapse(text))


def word_count(normalized: Column) -> Column:
    """Words of a collapsed text."""
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " ")))


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    """Collapsed whitespace and full case folding."""
    return text.fillna("").map(lambda s: " ".join(s.split()).casefold())


@F.pandas_udf(T.StringType())
def record_digest(fields: pd.DataFrame) -> pd.Series:
    """SHA-256 of the compact JSON list of a record's raw fields."""
    rows = fields.fillna("").itertuples(index=False, name=None)
    return pd.Series([hashlib.sha256(json.dumps(list(r), ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest() for r in rows])


# The literals taken for missing.
PLACEHOLDERS = ("nan", "none", "null", "na", "n/a", "missing")


def has_placeholder(text: Column) -> Column:
    """A literal that stands for a missing text, stripped and case-folded (the long s is the one letter that only folding makes an s)."""
    return F.translate(F.lower(strip(text)), "\u017f", "s").isin(*PLACEHOLDERS)


def has_replacement(text: Column) -> Column:
    return F.contains(text, F.lit(chr(0xFFFD)))


def has_control(text: Column) -> Column:
    """A control character other than tab and line break."""
    return F.rlike(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"))
