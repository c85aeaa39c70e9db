"""Canonical entity labels and keys (H1, H2) as columns.

ASCII labels are normalised by built-in expressions; only the others travel to
an Arrow UDF, since Spark has neither NFKC nor case folding.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The type words that an extractor may append in brackets.
TYPE_WORDS = ("method", "dataset", "metric", "concept", "finding", "tool", "unknown")

_SUFFIX = re.compile(r"(?: ?\[ ?(?:" + "|".join(TYPE_WORDS) + r") ?\] ?)+\Z", re.IGNORECASE)
_ASCII_SPACE = r"[\t-\r\x1c-\x20]+"
_JAVA_SUFFIX = r"(?i)(?: ?\[ ?(?:" + "|".join(TYPE_WORDS) + r") ?\] ?)++\z"


def canonical_label(value: str | None) -> str:
    """NFKC, white space collapsed, trailing bracketed type words removed as often as they occur, trimmed."""
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", value or ""))
    return _SUFFIX.sub("", text).strip()


def canonical_key(value: str | None) -> str:
    return canonical_label(value).casefold()


def _column(col: Column, fold: bool) -> Column:
    from pyspark.sql.functions import arrow_udf

    work = canonical_key if fold else canonical_label

    @arrow_udf(T.StringType())
    def slow(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else work(v) for v in values.to_pylist()], pa.string())

    ascii_only = ~col.rlike(r"[^\x00-\x7f]")
    flat = F.regexp_replace(col, _ASCII_SPACE, " ")
    # A label without a bracket has no suffix; most have none.
    fast = F.trim(F.when(F.contains(flat, F.lit("]")), F.regexp_replace(flat, _JAVA_SUFFIX, "")).otherwise(flat))
    fast = F.lower(fast) if fold else fast
    return F.when(ascii_only, fast).otherwise(slow(F.when(~ascii_only, col)))


def label_column(col: Column) -> Column:
    """The readable canonical label; null for null."""
    return _column(col, fold=False)


def key_column(col: Column) -> Column:
    """The identity key of a label; null for null, '' for a label without content."""
    return _column(col, fold=True)
