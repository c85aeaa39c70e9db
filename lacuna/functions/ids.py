"""Paper ids as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def id_form(col: Column) -> Column:
    """An id without surrounding blanks, tabs and line breaks, in lower case; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(col, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), F.lit(""))
