"""Identities, seeds and descriptions of candidates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(family: Column, head: Column, relation: Column, tail: Column, concept: Column, members: Column) -> Column:
    """A typed text that names a candidate by what defines it."""
    none = F.lit("")
    text = lambda c: F.coalesce(c.cast("string"), none)
    return (
        F.when(family == "missing_link", F.concat_ws("|", family, text(head), text(relation), text(tail)))
        .when(family == "orphan_cluster", F.concat_ws("|", family, F.array_join(F.array_sort(F.coalesce(members, F.array().cast("array<string>"))), "|")))
        .when(family == "temporal_decay", F.concat_ws("|", family, text(concept)))
        .otherwise(F.coalesce(family, F.lit("unknown")))
    )


def review_key(identity_text: Column) -> Column:
    """16 hex digits for carrying reviews over from an earlier run."""
    return F.concat(F.lit("post_gate_"), F.substring(F.sha2(identity_text, 256), 1, 16))


def stable_seed(identity_text: Column, base: int = 42) -> Column:
    """A seed fixed by the candidate and the base seed."""
    return F.lit(base).cast("bigint") + F.conv(F.substring(F.sha2(identity_text, 256), 1, 8), 16, 10).cast("bigint")


def describe(family: Column, head: Column, tail: Column, common: Column, size: Column, inter_ratio: Column, members: Column, concept: Column, peak: Column, decay: Column) -> Column:
    """A sentence on what the detector saw."""
    return (
        F.when(family == "missing_link", F.format_string("'%s' and '%s' share %d neighbours but no observed relation.", head, tail, common.cast("bigint")))
        .when(family == "orphan_cluster", F.format_string("A cluster of %d concepts with %.1f%% of its links outside: %s.", size.cast("bigint"), inter_ratio * 100, F.array_join(F.slice(members, 1, 5), ", ")))
        .when(family == "temporal_decay", F.format_string("'%s' peaked in %d; its share of papers fell by %.0f%% between the two windows.", concept, peak, decay * 100))
    )


def slug(col: Column, length: int = 30) -> Column:
    return F.substring(F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9]+", "_"), 1, length)


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(low)), F.lit(high))


def integer_keys(counts: Column) -> Column:
    """A map with text years as keys, by number; keys that are no number fall away."""
    return F.transform_keys(F.map_filter(counts, lambda k, v: k.try_cast("int").isNotNull()), lambda k, v: k.try_cast("int"))
