"""Frequency of every term by a vertical layout: compressed record bitmaps per term.

Records are numbered by a kept dictionary: a record's number never changes, and
a batch's new records get new numbers.  A block is up to 65,536 numbers.  Per
term and block there is a container (sorted 16-bit numbers while they are fewer
than 4,096, else 65,536 bits) and, in parallel, the counts of occurrences.  Tasks
and batches make containers of whatever rows they hold; those of one term and
block are merged by union, their counters by sum, and document frequencies are
read from the cardinalities.

Nothing hangs on which rows a task sees: a record with very many rows can be
split among tasks, and a task holds no more than ``FLUSH`` rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.plans.runtime import Folder, Scratch, ship

BLOCK = 65_536
DENSE = 4_096
FLUSH = 300_000
_SCHEMA = "term string, block bigint, records binary, dense boolean, n_first bigint, n_second bigint"


def containers(block: np.ndarray, low: np.ndarray, first: pa.Array, second: pa.Array) -> pa.RecordBatch:
    """The index rows of some rows; block is -1 where a row has no record."""
    n = len(block)
    terms = pa.chunked_array([first, second], pa.string()).combine_chunks().dictionary_encode()
    words = terms.dictionary
    code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    names, which = np.unique(block, return_inverse=True)
    group = np.concatenate((which, which)) + code * max(len(names), 1)
    there = code >= 0
    used, at = np.unique(group[there], return_inverse=True)
    role = np.repeat((0, 1), n)[there]
    n_first, n_second = (np.bincount(at[role == k], minlength=len(used)) for k in (0, 1))
    recorded = np.concatenate((block, block))[there] >= 0
    key = np.unique(at[recorded] * BLOCK + np.concatenate((low, low))[there][recorded])
    numbers_, card = (key % BLOCK).astype("<u2"), np.bincount(key // BLOCK, minlength=len(used))
    ends, dense = np.cumsum(card), card >= DENSE
    if dense.any():
        raw = pa.array([_bits(p) if d else p.tobytes() for p, d in zip(np.split(numbers_, ends[:-1]), dense, strict=True)], pa.binary())
    else:
        raw = pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(np.r_[0, ends * 2].astype(np.int32)), pa.py_buffer(numbers_.tobytes())])
    of_term, of_block = used // max(len(names), 1), names[used % max(len(names), 1)] if len(used) else used
    return pa.RecordBatch.from_arrays([words.take(pa.array(of_term)), pa.array(of_block), raw, pa.array(dense), pa.array(n_first), pa.array(n_second)], names=["term", "block", "records", "dense", "n_first", "n_second"])


def _bits(numbers: np.ndarray) -> bytes:
    bits = np.zeros(BLOCK, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def numbers(records: bytes, dense: bool) -> np.ndarray:
    """The record numbers in a container."""
    if dense:
        return np.flatnonzero(np.unpackbits(np.frombuffer(records, np.uint8), bitorder="little")).astype("<u2")
    return np.frombuffer(records, "<u2")


def union(*parts: tuple[bytes, bool]) -> tuple[bytes, bool]:
    """The container of the records in any of the containers."""
    if any(dense for _, dense in parts):
        bits = np.zeros(BLOCK // 8, np.uint8)
        for raw, dense in parts:
            bits |= np.frombuffer(raw if dense else _bits(numbers(raw, False)), np.uint8)
        return bits.tobytes(), True
    every = np.unique(np.concatenate([numbers(raw, False) for raw, _ in parts]))
    return (_bits(every), True) if len(every) >= DENSE else (every.astype("<u2").tobytes(), False)


def united(index: DataFrame) -> DataFrame:
    """An index with one row a term and block: containers united, counters added.

    A term's rows come together, so that what follows by term needs no shuffle;
    there is one for each task and batch that saw the term in a block, however
    often it occurs.
    """
    from pyspark.sql.functions import arrow_udf

    ship(index.sparkSession)

    def unite(lists: pa.Array) -> pa.Array:
        kind = pa.struct([("records", pa.binary()), ("dense", pa.bool_())])
        done = [None if parts is None else dict(zip(("records", "dense"), union(*((p["records"], p["dense"]) for p in parts)), strict=True)) for parts in lists.to_pylist()]
        return pa.array(done, kind)

    part = F.struct("records", "dense")
    g = index.repartition("term").groupBy("term", "block").agg(F.collect_list(part).alias("parts"), F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"))
    several = arrow_udf(unite, "records binary, dense boolean")(F.when(F.size("parts") > 1, F.col("parts")))
    return g.select("term", "block", F.coalesce(several, F.col("parts")[0]).alias("c"), "n_first", "n_second").select("term", "block", "c.records", "c.dense", "n_first", "n_second")


def frequencies(index: DataFrame) -> DataFrame:
    """(term, n_first, n_second, records) of an index with one row a term and block."""
    card = F.when(F.col("dense"), F.expr("bitmap_count(records)")).otherwise(F.expr("octet_length(records) div 2")).cast("long")
    return index.groupBy("term").agg(F.sum("n_first").alias("n_first"), F.sum("n_second").alias("n_second"), F.sum(card).alias("records"))


class Vocabulary:
    """An index kept in a folder: the dictionary of records and the containers, batch by batch.

    Opened at a folder that holds one already, it goes on from there.  A batch
    counts once its commit file is there; one that broke off leaves no trace.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)
        self.path = self.folder.path

    def parts(self) -> list[str]:
        return [name.split(".")[1] for name in self.folder.names("commits")]

    def _records(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema("rec string, block bigint, low int").parquet(*[f"{self.path}/records/{p}" for p in parts])

    def add(self, df: DataFrame, record: str, first: str, second: str | None = None) -> None:
        """Add df's rows.

        Null and empty terms don't count; rows of a null record count as
        occurrences without a record; repeated rows count each time, in later
        batches too; columns of other names are not read.  An empty df adds
        nothing.
        """
        ship(self.spark)
        old, part = self.parts(), uuid.uuid4().hex
        term = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c else F.lit(None).cast("string")
        rec = F.col(record).cast("string").alias("rec")
        new = df.select(rec).where("rec is not null").distinct()
        if old:
            new = new.join(self._records(old), "rec", "left_anti")
        # A number is its batch, partition and place there; it is written once and stays.
        new = new.withColumn("no", F.monotonically_increasing_id())
        new = new.select("rec", (F.shiftright("no", 16) + F.lit(len(old) << 48)).alias("block"), F.col("no").bitwiseAND(BLOCK - 1).cast("int").alias("low"))
        new.write.parquet(f"{self.path}/records/{part}")
        rows = df.select(rec, term(first).alias("a"), term(second).alias("b")).where("a is not null or b is not null")
        # Rows without a record find none, wherever they are; so they are dealt out evenly.
        found = F.coalesce("rec", F.concat(F.lit("\x00"), F.pmod(F.xxhash64("a", "b"), F.lit(1 << 16)).cast("string")))
        known = self._records([*old, part]).withColumnRenamed("rec", "found")
        rows = rows.withColumn("found", found).drop("rec").join(known, "found", "left").select(F.coalesce("block", F.lit(-1).cast("bigint")).alias("block"), F.coalesce("low", F.lit(0)).alias("low"), "a", "b")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def done() -> pa.RecordBatch:
                t = pa.Table.from_batches(held).combine_chunks()
                block, low = (t.column(c).to_numpy() for c in (0, 1))
                return containers(block, low.astype(np.int64), *(t.column(c).combine_chunks() if t.column(c).num_chunks != 1 else t.column(c).chunk(0) for c in (2, 3)))

            for batch in batches:
                for at in range(0, batch.num_rows, FLUSH):
                    held.append(batch.slice(at, FLUSH))
                    size += held[-1].num_rows
                    if size >= FLUSH:
                        yield done()
                        held, size = [], 0
            if size:
                yield done()

        rows.mapInArrow(run, _SCHEMA).write.parquet(f"{self.path}/containers/{part}")
        self.folder.write(f"commits/{len(old):06d}.{part}", json.dumps({"record": record, "first": first, "second": second}))

    def index(self) -> DataFrame:
        """(term, block, records, dense, n_first, n_second), one row a term and block."""
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], _SCHEMA)
        return united(self.spark.read.schema(_SCHEMA).parquet(*[f"{self.path}/containers/{p}" for p in parts]))


def build_index(df: DataFrame, record: str, first: str, second: str | None = None) -> DataFrame:
    """(term, block, records, dense, n_first, n_second) for one table's term columns; see Vocabulary."""
    v = Vocabulary(df.sparkSession, f"{Scratch(df.sparkSession, 'vocabulary').root}/index")
    v.add(df, record, first, second)
    return v.index()


def marked(freq: DataFrame, n_records: DataFrame, rare_most: int = 2, common_percent: int = 1) -> DataFrame:
    """freq with ``mark``: 'rare' up to ``rare_most`` occurrences, 'common' in more than that percentage of all records, else null.

    n_records: one row, one column: the number of all records.
    """
    total = n_records.toDF("n_all")
    occurs = F.col("n_first") + F.col("n_second")
    mark = F.when(occurs <= rare_most, "rare").when(F.col("records") * 100 > F.col("n_all") * common_percent, "common")
    return freq.join(F.broadcast(total)).withColumn("occurrences", occurs).withColumn("mark", mark).drop("n_all")  # one row
