"""Byte-pair encoding of a whole corpus with a public vocabulary.

A text is cut into pretokens by the vocabulary's pattern; each *distinct*
pretoken is encoded once per Python worker and looked up afterwards.  A pretoken
is encoded with a segment tree over the ranks of its adjacent pairs: the root
holds the leftmost pair of the lowest rank, a merge changes at most three
leaves, and each change climbs log2(n) nodes, so a run of n bytes without any
break costs n log n instead of n squared.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.plans.runtime import ship

NO_PAIR = 1 << 40
_CACHE_MAX = 1_000_000
_BATCH_CHARS = 4_000_000


def default_vocabulary() -> tuple[str, str]:
    """(path of the byte_bpe_50k ranks, pretoken pattern) of the installed public tokenizers."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


@lru_cache(maxsize=4)
def ranks_of(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pretoken: always the lowest-ranked pair first, the leftmost of equal ones."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    width = 1 << max(0, n - 2).bit_length()  # leaves: the n-1 adjacent pairs
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i stops
    before = list(range(-1, n - 1))  # start of the part before
    get = ranks.get
    # A node holds rank * n + place, so that the least one is the lowest rank, leftmost.
    none = NO_PAIR * n
    tree = [none] * (2 * width)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[width + i] = r * n + i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a < b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1

    def pair(i: int) -> int:
        j = end[i]
        if j >= n:
            return none
        r = get(piece[i : end[j]])
        return none if r is None else r * n + i

    while tree[1] < none:
        i = tree[1] % n
        j = end[i]
        end[i] = end[j]
        if end[j] < n:
            before[end[j]] = i
        put(j, none) if j < n - 1 else None
        put(i, pair(i)) if i < n - 1 else None
        if before[i] >= 0:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts; keeps what it has encoded, up to a bound."""

    def __init__(self, blob: bytes, pattern: str):
        self.ranks = ranks_of(blob)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = _Known(self.ranks)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            known = self.known
            for p in self.split(text):
                out += known[p]
        return out


class _Known(dict):
    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = encode_piece(piece.encode(), self.ranks)
        if len(piece) <= 64:  # long runs hardly come again
            if len(self) >= _CACHE_MAX:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def encoder(blob: bytes, pattern: str) -> Encoder:
    return Encoder(blob, pattern)


def _read(path: str) -> bytes:
    return Path(path).read_bytes()


def encode_column(df: DataFrame, text: str, key: str, vocabulary: str | None = None, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """(key, ids): the token ids of every row's whole text, without special tokens.

    Null and empty texts give an empty list; rows are kept one to one, repeated
    ones too; other columns of df are not read.  ``vocabulary`` is the path of a
    rank file (base64 bytes and rank a line), read by the driver and sent to the
    workers (below 1 MB).  An empty df gives an empty result.
    """
    default, default_pattern = default_vocabulary()
    blob = df.sparkSession.sparkContext.broadcast(_read(vocabulary or default))
    pattern = pattern or default_pattern
    ship(df.sparkSession)
    key_type = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value, pattern)
        known, split = enc.known, enc.split
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at, size = 0, 0
            for stop in range(1, len(texts) + 1):  # very long texts make smaller batches
                size += len(texts[stop - 1] or "")
                if size < _BATCH_CHARS and stop < len(texts):
                    continue
                flat: list[int] = []
                ends = np.zeros(stop - at + 1, np.int32)
                for i in range(at, stop):
                    if t := texts[i]:
                        for p in split(t):
                            flat += known[p]
                    ends[i - at + 1] = len(flat)
                values = pa.array(np.array(flat, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, stop - at), pa.ListArray.from_arrays(pa.array(ends), values)], names=["k", "ids"])
                at, size = stop, 0

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, _schema("k", key_type, "array<int>"))
    return out.select(F.col("k").alias(key), F.col("ids").alias(ids))


def count_column(df: DataFrame, text: str, keep: list[str], vocabulary: str | None = None, pattern: str | None = None, name: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of every row's whole text (0 for null and empty ones)."""
    from pyspark.sql import types as T

    default, default_pattern = default_vocabulary()
    blob = df.sparkSession.sparkContext.broadcast(_read(vocabulary or default))
    pattern = pattern or default_pattern
    ship(df.sparkSession)
    picked = df.select(*[F.col(c) for c in keep], F.col(text).alias("_t"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(blob.value, pattern)
        known, split = _Lengths(enc.known), enc.split
        for batch in batches:
            n = [sum(map(known.__getitem__, split(t))) if t else 0 for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, name])

    return picked.mapInArrow(run, schema)


class _Lengths(dict):
    def __init__(self, known: dict[str, list[int]]):
        super().__init__()
        self.known = known

    def __missing__(self, piece: str) -> int:
        n = len(self.known[piece])
        if len(piece) <= 64:
            if len(self) >= _CACHE_MAX:
                self.clear()
            self[piece] = n
        return n


def _schema(key: str, key_type, value: str) -> str:
    return f"`{key}` {key_type.simpleString()}, ids {value}"
