"""Deterministic draws: uniform numbers from a hash of what is drawn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by the parts' text, the same in any engine with MD5."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
