"""Signing a table's rows for the near-duplicate operators.

Two passes over the texts: the first gives every row's set digest and a count of
rows per shingle slot (counters over all rows, merged from the tasks' partial
counts); the second orders each row's shingles by these counts,
rarest first, and gives the elements that any likely partner must share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import shingles as S
from lacuna.plans import slots
from lacuna.plans.runtime import Scratch, ship

BLOCKS = 64
PRINTS = ("f0", "f1", "f2", "f3")
_CHUNK_CHARS = 8_000_000
_ELEMENTS = 500_000
_PAIRS = 1 << 64 - S.HASH_BITS - 1


def _texts(batch: pa.RecordBatch, first: int) -> list[str]:
    """The text columns of a batch joined by blanks, nulls as ''."""
    cols = [c.to_pylist() for c in batch.columns[first:]]
    if len(cols) == 1:
        return [a or "" for a in cols[0]]
    return [" ".join(x or "" for x in row) for row in zip(*cols, strict=True)]


def _parts(batch: pa.RecordBatch, first: int) -> Iterator[tuple[int, list[str]]]:
    """(offset, texts): the batch in parts of bounded text, for very long rows."""
    texts, at, size = _texts(batch, first), 0, 0
    for stop in range(1, len(texts) + 1):
        size += len(texts[stop - 1])
        if size >= _CHUNK_CHARS or stop == len(texts):
            yield at, texts[at:stop]
            at, size = stop, 0


def counters(df: DataFrame) -> int:
    """How many shingle counters a table gets: 2**21, more for tables beyond 8 GB, 2**24 (64 MB) at most.

    They only order shingles by how common they are; any order is exact.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return 1 << 21 + min(3, max(0, (size >> 33).bit_length()))


def signed(df: DataFrame, key: str, texts: list[str], k: int, min_words: int, width: int, sets: bool = False) -> DataFrame:
    """(key, n, d1, d2[, f0..f3, shingles], block, payload): one pass over the texts.

    A row a text that has a set, with the set's size and digest (and its odd
    sketch of 256 bits and the packed set); further rows, with ``block``, hold the task's counts of rows a shingle
    slot (``width`` of them; none for 0).
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ship(df.sparkSession)
    key_type = to_arrow_type(df.schema[key].dataType)
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.IntegerType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType())])
    if sets:
        for c in PRINTS:
            schema = schema.add(c, T.LongType())
        schema = schema.add("shingles", T.BinaryType())
    schema = schema.add("block", T.IntegerType()).add("payload", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.uint32)
        for batch in batches:
            for at, part in _parts(batch, 1):
                s, ends = S.shingle_sets(part, k, min_words)
                if width:
                    counts += np.bincount(S.slot(s, width), minlength=width).astype(np.uint32)
                sizes = np.diff(ends, prepend=0)
                rows = np.flatnonzero(sizes)
                each = [s[ends[i] - sizes[i] : ends[i]] for i in rows]
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in each), np.int64).reshape(-1, 2)
                none = pa.nulls(len(rows))
                cols = [batch.column(0).take(pa.array(rows + at)), pa.array(sizes[rows], pa.int32()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))]
                if sets:
                    f = S.odd_sketch(s, ends, len(PRINTS))[rows].view(np.int64)
                    cols += [*(pa.array(np.ascontiguousarray(f[:, i])) for i in range(len(PRINTS))), pa.array([S.pack(x) for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, none.cast(pa.int32()), none.cast(pa.binary())], names=schema.names)
        parts = payloads(counts)
        none = pa.nulls(parts.num_rows)
        cols = [pa.nulls(parts.num_rows, key_type), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64())] + ([none.cast(pa.int64())] * len(PRINTS) + [none.cast(pa.binary())] if sets else [])
        yield pa.RecordBatch.from_arrays([*cols, *parts.columns], names=schema.names)

    return df.select(F.col(key).alias("key"), *texts).where(F.col("key").isNotNull()).mapInArrow(run, schema)


def payloads(counts: np.ndarray) -> pa.RecordBatch:
    """(block, payload): a task's counts, none if there are none."""
    parts = [zlib.compress(x.tobytes(), 1) for x in counts.reshape(BLOCKS, -1)] if counts.any() else []
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["block", "payload"])


def total_counts(done: DataFrame, width: int) -> np.ndarray:
    """The counts of all tasks of ``signed`` together."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(width // BLOCKS, np.uint32)
        for x in t.column("payload").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "payload": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    # At most BLOCKS rows, ``width`` counters together, whatever the data.
    merged = done.where("block is not null").select("block", "payload").groupBy("block").applyInArrow(add, "block int, payload binary").collect()
    counts = np.zeros((BLOCKS, width // BLOCKS), np.uint32)
    for r in merged:
        counts[r["block"]] = np.frombuffer(zlib.decompress(bytes(r["payload"])), np.uint32)
    return counts.reshape(-1)


def first_pass(df: DataFrame, key: str, texts: list[str], scratch: Scratch, k: int, min_words: int) -> tuple[DataFrame, np.ndarray]:
    """(digests, counts).  digests: (key, n, d1, d2) of every row that has a set; counts: rows per shingle slot."""
    width = counters(df)
    done = scratch.save(signed(df, key, texts, k, min_words, width), "signed")
    return done.where("block is null").select("key", "n", "d1", "d2"), total_counts(done, width)


def classes(digests: DataFrame, scratch: Scratch, repeated_only: bool = True) -> DataFrame:
    """(key, rep): rows of one set with the smallest of their keys; by default only sets of several rows."""
    groups = digests.groupBy("d1", "d2", "n").agg(F.min("key").alias("rep"), F.count("*").alias("copies"))
    if repeated_only:
        groups = groups.where("copies > 1")
    return scratch.save(digests.join(groups.drop("copies"), ["d1", "d2", "n"]).select("key", "rep"), "classes")


def without(df: DataFrame, key: str, drop: DataFrame) -> DataFrame:
    """df without the rows whose key is in drop(key); only rows that may be in it are shuffled."""
    marked = slots.flag(df, key, slots.bitmap_of(drop, "key"), "maybe_there")
    sure = marked.where("not maybe_there").drop("maybe_there")
    rest = marked.where("maybe_there").drop("maybe_there").join(drop.select(F.col("key").alias(key)), key, "left_anti")
    return sure.unionByName(rest)


def only(df: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """The rows of df whose key may be in keep(key): all that are, and a few others."""
    return slots.flag(df, key, slots.bitmap_of(keep, "key"), "maybe_there").where("maybe_there").drop("maybe_there")


def set_table(df: DataFrame, key: str, texts: list[str], k: int, min_words: int) -> DataFrame:
    """(key, shingles binary): each row's packed set, sorted."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in _parts(batch, 1):
                s, ends = S.shingle_sets(part, k, min_words)
                raw = [S.pack(x) for x in np.split(s, ends[:-1])] if len(part) else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(raw, pa.binary())], names=schema.names)

    return df.select(F.col(key).alias("key"), *texts).mapInArrow(run, schema)


def within_reach(pairs: DataFrame, prints: DataFrame, t: float, more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (a, b, more...) whose likeness may be t by the odd sketches of (key, n, f0..f3): so sets travel only where these leave it open."""
    side = lambda p: prints.select(F.col("key").alias(p), *[F.col(c).alias(p + c) for c in ("n", *PRINTS)])
    x = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col(f"a{c}").bitwiseXOR(F.col(f"b{c}"))) for c in PRINTS[1:]), F.bit_count(F.col(f"a{PRINTS[0]}").bitwiseXOR(F.col(f"b{PRINTS[0]}"))))
    return x.where(apart <= (1 - t) / (1 + t) * (F.col("an") + F.col("bn")) + S.EPS).select("a", "b", *more)


def verified(pairs: DataFrame, sets: DataFrame, t: float, more: tuple[str, ...] = ()) -> DataFrame:
    """The pairs (a, b, more...) whose likeness is at least t by their whole sets, with that likeness."""
    x = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a")
    x = x.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b").select("sa", "sb", "a", "b", *more)
    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b", *more)] + [T.StructField("likeness", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = likeness(batch.column(0), batch.column(1))
            keep = np.flatnonzero(like >= t - S.EPS)
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[2:]), pa.array(like[keep])], names=schema.names)

    return x.mapInArrow(run, schema)


def _elements(sets: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all sets end to end, size of each)."""
    bounds = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1].astype(np.int64)
    raw = np.frombuffer(sets.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    return S.unpack(raw), np.diff(bounds) * 8 // S.HASH_BITS


def likeness(left: pa.BinaryArray, right: pa.BinaryArray) -> np.ndarray:
    """The likeness of each two packed sets: one sort of (pair, hash) for as many pairs as _ELEMENTS allows."""
    (a, na), (b, nb) = _elements(left), _elements(right)
    pair_a, pair_b = (np.repeat(np.arange(len(n), dtype=np.uint64), n) for n in (na, nb))
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    common, at = np.zeros(len(na), np.int64), 0
    while at < len(na):
        low_a, low_b = ends_a[at] - na[at], ends_b[at] - nb[at]
        stop = max(at + 1, min(int(np.searchsorted(ends_a + ends_b, low_a + low_b + _ELEMENTS)), at + _PAIRS))
        high_a, high_b = ends_a[stop - 1], ends_b[stop - 1]
        base = np.uint64(at)
        x = np.concatenate(((pair_a[low_a:high_a] - base) << np.uint64(S.HASH_BITS) | a[low_a:high_a], (pair_b[low_b:high_b] - base) << np.uint64(S.HASH_BITS) | b[low_b:high_b]))
        x.sort()
        twice = (x[1:][x[1:] == x[:-1]] >> np.uint64(S.HASH_BITS)).astype(np.int64)
        common[at:stop] = np.bincount(twice, minlength=stop - at)
        at = stop
    total = na + nb - common
    return np.where(total > 0, common / np.maximum(total, 1), 0.0)
