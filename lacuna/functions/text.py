"""Text functions as columns: cleaning, chunking, tokens, specificity, extraction, similarity."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Phrases that name no particular thing.
GENERIC_PHRASES = (
    "algorithm", "analysis", "approach", "concept", "framework", "method", "model", "our approach", "our framework",
    "our method", "proposed approach", "proposed framework", "proposed method", "research", "system", "technique",
    "this paper", "this work",
)

# Words that never count as tokens.
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "using", "via", "with")


# What counts as white space (as Python's str.split has it).
_SPACE = r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def truthy(col: Column) -> Column:
    """The column, null where a text is empty or a number zero (blanks count as content)."""
    return F.when((col.cast("string") != "") & (col.cast("string") != "0"), col)


def clean_text(col: Column) -> Column:
    """White space collapsed and trimmed (H3)."""
    return F.trim(F.regexp_replace(col, _SPACE, " "))


def words(col: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(clean_text(col), " "), lambda w: w != "")


def word_count(col: Column) -> Column:
    return F.coalesce(F.size(words(col)), F.lit(0))


def chunk_words(col: Column, size: int = 1500, overlap: int = 200) -> Column:
    """Windows of ``size`` words, each ``overlap`` words into the last one (H4); null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below the chunk size")
    step = size - overlap
    w = words(col)
    n = F.size(w)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step)))
    return F.coalesce(F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, F.lit(size)), " ")), F.array().cast("array<string>"))


def tokens(col: Column) -> Column:
    """Distinct lower-case ASCII tokens without stopwords, also without a version's digits ('oauth2' gives 'oauth' too) (H5)."""
    stop = F.array(*map(F.lit, STOPWORDS))
    kept = F.array_except(F.regexp_extract_all(F.lower(col), F.lit("([a-z0-9]+)"), 1), stop)
    bare = F.filter(F.transform(kept, lambda t: F.regexp_replace(t, "[0-9]+$", "")), lambda t: t != "")
    return F.array_except(F.array_union(kept, bare), stop)


def specificity(labels: Column) -> Column:
    """How specific an array of canonical labels is, 0 to 1 (H6); 0 without labels."""

    def one(label: Column) -> Column:
        t = tokens(label)
        n = F.size(t)
        generic = F.size(F.array_intersect(t, F.array(*map(F.lit, GENERIC_PHRASES))))
        value = 0.75 * (1 - generic / n) + 0.25 * F.least(n / 3.0, F.lit(1.0))
        return F.when(F.lower(label).isin(*GENERIC_PHRASES) | (n == 0), F.lit(0.0)).otherwise(value)

    own = F.filter(labels, lambda x: x.isNotNull() & (x != ""))
    total = F.aggregate(F.transform(own, one), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(own) > 0, total / F.size(own)).otherwise(F.lit(0.0))


def document_text(*cols: Column) -> Column:
    """Lower-case join of the parts that have content."""
    return F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in cols]))


def extract_field(col: Column, name: str, labels: tuple[str, ...]) -> Column:
    """What follows ``name:`` up to the next of the labels or the end, trimmed; '' where it is missing."""
    stop = "|".join(labels)
    return F.trim(F.regexp_replace(F.regexp_extract(col, rf"(?s){name}:\s*(.*?)(?=\s*(?:{stop}):|\z)", 1), r"^\s+|\s+$", ""))


def duration_seconds(col: Column) -> Column:
    """Seconds of a text such as '1h2m3.5s'; null without any part."""
    part = lambda unit: F.regexp_extract(col, rf"([0-9]+(?:\.[0-9]+)?){unit}(?![a-z])", 1).try_cast("double")
    h, m, s = part("h"), part("m"), part("s")
    return F.when(F.coalesce(h, m, s).isNotNull(), F.coalesce(h, F.lit(0.0)) * 3600 + F.coalesce(m, F.lit(0.0)) * 60 + F.coalesce(s, F.lit(0.0)))


def strict_year(col: Column) -> Column:
    """A whole number written as such, else null: '2020' and ' 2020 ', not '2020.0' (B11)."""
    return F.regexp_extract(col.cast("string"), r"^\s*([+-]?[0-9]+)\s*$", 1).try_cast("int")


def year_of_date(col: Column) -> Column:
    """The number in a date text's first four characters, 0 if there is none."""
    return F.coalesce(F.substring(col, 1, 4).try_cast("int"), F.lit(0))


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len(a) + len(b)); 100 for two empty texts."""
    if not a and not b:
        return 100.0
    positions: dict[str, int] = {}
    for i, ch in enumerate(a):
        positions[ch] = positions.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:  # bit-parallel longest common subsequence
        match = row & positions.get(ch, 0)
        row = ((row + match) | (row - match)) & full
    lcs = len(a) - row.bit_count()
    return 100.0 * 2 * lcs / (len(a) + len(b))


def sort_key(label: str) -> str:
    """Lower-case alphanumeric tokens, sorted."""
    return " ".join(sorted("".join(c if c.isalnum() else " " for c in label.lower()).split()))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Similarity 0 to 100 of two labels whatever their word order (H9)."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(T.DoubleType())
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else float(round(indel_ratio(sort_key(p), sort_key(q)))) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    return ratio(a, b)


