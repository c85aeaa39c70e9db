"""Splitting oversized texts at topic boundaries (lexical cohesion).

Natural boundaries come in classes: the end of a paragraph, of a sentence or
line, of a clause, of a word.  At a boundary the words of the blocks before and
after it are compared as the blocks slide along the text; its depth is how far
their similarity lies below the peaks on either side.  A piece ends at the
deepest valley among the boundaries of the best class that its size window has,
and anywhere between two characters only where the window has none at all.  The
next piece begins up to ``overlap`` characters earlier, at the best boundary that
leaves at least half of that overlap.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.plans.runtime import ship

_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’)\]]*\s+|[。！？｡]+[」』”’）]*\s*|\n\s*")
_CLAUSE = re.compile(r"[,;:)\]–—]+\s+|[，、；：]\s*")
_BLANK = re.compile(r"\s+")
_WORD = re.compile(r"[^\W_]+")
_JOINED = "\u200d\ufe0e\ufe0f"
BLOCK = 60


def boundaries(text: str) -> tuple[list[int], list[int], list[int]]:
    """Places after a paragraph's end, after a sentence's or line's end (paragraphs too), after a clause (all of these)."""
    inner = lambda pattern: {m.end() for m in pattern.finditer(text) if m.end() < len(text)}
    paragraphs = inner(_PARAGRAPH)
    sentences = paragraphs | inner(_SENTENCE)
    return sorted(paragraphs), sorted(sentences), sorted(sentences | inner(_CLAUSE))


class _Words:
    """A text's words by place; letters written without blanks count by twos."""

    def __init__(self, text: str):
        self.starts: list[int] = []
        self.words: list[str] = []
        for m in _WORD.finditer(text.lower() if len(text.lower()) == len(text) else text):
            w, at = m.group(), m.start()
            if w[0] < "\u2e80":
                if len(w) > 3:
                    self.starts.append(at)
                    self.words.append(w)
                continue
            for i in range(max(1, len(w) - 1)):
                self.starts.append(at + i)
                self.words.append(w[i : i + 2])

    def depths(self, places: list[int], block: int) -> list[float]:
        """The depth of the valley of word similarity at each of the places, which ascend."""
        left, right = Counter(), Counter()
        low = mid = high = 0
        sims: list[float] = []
        for place in places:  # both blocks slide to the place
            to = bisect_left(self.starts, place)
            for w in self.words[high : min(to + block, len(self.words))]:
                right[w] += 1
            high = max(high, min(to + block, len(self.words)))
            for w in self.words[mid:to]:
                _take(right, w)
                left[w] += 1
            mid = to
            for w in self.words[low : max(low, to - block)]:
                _take(left, w)
            low = max(low, to - block)
            small, large = (left, right) if len(left) < len(right) else (right, left)
            dot = sum(n * large.get(w, 0) for w, n in small.items())
            norm = sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
            sims.append(dot / norm if norm else 0.0)
        up = _climb(sims)
        down = _climb(sims[::-1])[::-1]
        return [a + b - 2 * s for a, b, s in zip(up, down, sims, strict=True)]


def _take(bag: Counter, w: str) -> None:
    if bag[w] == 1:
        del bag[w]
    else:
        bag[w] -= 1


def _climb(sims: list[float]) -> list[float]:
    """For each place the peak to which similarity climbs without a fall on the way back to the start."""
    out, peak = [], 0.0
    for i, s in enumerate(sims):
        peak = max(s, peak) if i and s <= sims[i - 1] else s
        out.append(peak)
    return out


def _whole(text: str, at: int) -> bool:
    """Whether a cut at this place parts no character from the marks that belong to it."""
    return not (0 < at < len(text) and (unicodedata.combining(text[at]) or text[at] in _JOINED or text[at - 1] == "\u200d"))


def split(text: str, limit: int = 2000, overlap: int = 200, block: int = BLOCK) -> list[tuple[int, int]]:
    """(start, end) of the pieces; a text within the limit is one piece, an empty one none.

    A piece's window is the second half of the limit.  Where it has no sentence
    end, but the first half has one and the sentence after it fits into a piece,
    the cut is there; so a sentence within the limit is not cut unless its piece
    would have to be.
    """
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be below half of the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    words, classes = _Words(text), boundaries(text)
    depth = [dict(zip(c, words.depths(c, block), strict=True)) for c in classes]
    sentences = classes[1]
    pieces, start, cut = [], 0, 0
    while n - start > limit:
        low, high = max(cut + 1, start + limit // 2), start + limit
        last, cut = pieces[-1][1] if pieces else 0, 0
        for c, d in zip(classes, depth, strict=True):
            if c is classes[2] and (cut := _early(sentences, low, last, n, limit)):
                break
            if inside := c[bisect_left(c, low) : bisect_right(c, high)]:
                cut = max(inside, key=lambda p: (d[p], p))  # of equal valleys the later one
                break
        if not cut:
            blanks = [m.end() for m in _BLANK.finditer(text, low, high) if low <= m.end() <= high]
            if blanks:
                cut = max(zip(words.depths(blanks, block), blanks, strict=True))[1]
            else:
                cut = next((p for p in range(high, low, -1) if _whole(text, p)), high)
        pieces.append((start, cut))
        start = _back(text, classes, cut, max(cut - overlap, start + 1), limit)
    pieces.append((start, n))
    return pieces


def _early(sentences: list[int], low: int, last: int, n: int, limit: int) -> int:
    """The last sentence end before the window (and after the last cut) if the sentence that begins there fits into a piece, else 0."""
    i = bisect_left(sentences, low) - 1
    if i < 0 or sentences[i] <= last:
        return 0
    end = sentences[i + 1] if i + 1 < len(sentences) else n
    return sentences[i] if end - sentences[i] <= limit else 0


def _back(text: str, classes: tuple[list[int], list[int], list[int]], cut: int, least: int, limit: int) -> int:
    """Where the overlap begins: not before ``least``, and late enough for the sentence after the cut to fit into the piece."""
    sentences = classes[1]
    i = bisect_right(sentences, cut)
    end = sentences[i] if i < len(sentences) else len(text)
    if limit >= end - cut > limit - (cut - least):
        least = end - limit
    if least >= cut:
        return cut
    enough = least + (cut - least + 1) // 2
    for c in classes[1:]:
        i = bisect_left(c, least)
        if i < len(c) and c[i] <= enough and c[i] < cut:
            return c[i]
    m = _BLANK.search(text, max(0, least - 1), cut)
    if m and least <= m.end() <= enough and m.end() < cut:
        return m.end()
    return next((p for p in range(least, cut) if _whole(text, p)), cut)


def split_oversized(df: DataFrame, text: str, key: str, limit: int = 2000, overlap: int = 200, block: int = BLOCK) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, piece) of every row whose text exceeds ``limit`` code points.

    Pieces have at most ``limit`` characters; together they cover the text, each
    shares up to ``overlap`` characters with the next.  Null, empty and short
    texts need no splitting and give no rows; equal texts and repeated keys are
    split row by row; null keys stay null; columns of other names are not read.
    The length test runs before Python, so only oversized texts travel there.
    """
    ship(df.sparkSession)
    picked = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.length("t") > limit)
    schema = T.StructType(
        [
            T.StructField("k", df.schema[key].dataType),
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("piece", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cols = [], ([], [], [], [], [])
            for i, t in enumerate(batch.column(1).to_pylist()):
                cuts = split(t, limit, overlap, block)
                for no, (s, e) in enumerate(cuts):
                    rows.append(i)
                    for c, v in zip(cols, (no, len(cuts), s, e, t[s:e]), strict=True):
                        c.append(v)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(c, ty) for c, ty in zip(cols, (pa.int32(),) * 4 + (pa.string(),), strict=True))], names=schema.names)

    return picked.mapInArrow(run, schema).withColumnRenamed("k", key)
