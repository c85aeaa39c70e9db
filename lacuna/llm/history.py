"""Deduplicating new batches against all accepted rows with a segment index.

A row's shingles, rarest first, are a string without repeats in one global
order.  Of two such strings the longest common subsequence is their common part,
so their edit distance (insertions and deletions) is the number of shingles in
which the rows differ, and a likeness bound is an edit-distance bound.  If at
most e edits fall on a string, one of any e + 1 disjoint segments of it survives;
the number e + 1 is fixed by the string's length.  The segments stored are the
e + 1 rarest places, one shingle each, with the string's length and the segment's
position.  A new row probes with its own segments; lengths and positions that the
bound rules out are passed over, and what is left is verified by whole sets.

(Segments of the raw text would bound the edit distance of the text, which says
nothing about likeness: a sentence moved to the end costs hundreds of edits and
hardly any likeness.  Segments of several shingles would need a probe for every
length and shift: some 43,000 for a row of 132 shingles, where single ones need 40.)

The index is a folder.  Segments stand in buckets by their hash, so a batch meets
them, and its own, without a shuffle of what is stored.  A batch's tables are
written first and count for nothing until its one commit file is there: a batch
that broke off leaves no trace in what is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm import shingles as S
from lacuna.llm import signatures as G
from lacuna.plans.runtime import Folder, Scratch, ship

MAX_ROUNDS = 500
MOST = 20_000
LEAF = 16
GROW = 4
_OLD = 1 << 31
_FLUSH = 100_000
_SETS = "key bigint, n int, d1 bigint, d2 bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint, shingles binary, block int, payload binary"
_IDS = "key bigint, id string, cls bigint"


def segments(sets: DataFrame, counts: np.ndarray, t: float) -> DataFrame:
    """(segment, key, meta) of (key, shingles); meta is length << 32 | position."""
    shared = sets.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, sizes = G._elements(batch.column(1))
            s, row, pos, n = S.ranked_prefixes(s << np.uint64(64 - S.HASH_BITS), np.cumsum(sizes), shared.value, t)
            keys = batch.column(0).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.view(np.int64), keys, n[row] << 32 | pos)], names=["segment", "key", "meta"])

    return sets.select("key", "shingles").mapInArrow(run, "segment bigint, key bigint, meta bigint")


def meetings(segment: np.ndarray, key: np.ndarray, meta: np.ndarray, t: float, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, overfull): pairs of rows that share a segment and may have a likeness of t, j new too unless it is old.

    Rows are sorted by segment; old ones have the bit _OLD in meta and never meet
    each other.  overfull: segments in which more than ``most`` new rows could
    meet one another; these do not, but they meet the old ones.
    """
    n, pos, old = meta >> 32, meta & (_OLD - 1), meta & _OLD != 0
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]]) if len(segment) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(segment)])
    # Of a pair, the smaller row's place lies in the prefix that is enough against sets not smaller.
    early = pos < S.short_prefix_len(n, t)
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        least, most_ = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        common = np.ceil(t / (1 + t) * (n[i] + n[j]) - S.EPS)
        return (least >= t * most_ - S.EPS) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= common) & ~(old[i] & old[j])

    small = np.repeat(sizes <= LEAF, sizes)
    for step in range(1, min(LEAF, int(sizes.max(initial=0)))):
        i = np.flatnonzero(small[:-step] & (segment[:-step] == segment[step:]))
        if not len(i):
            break
        i = i[alike(i, i + step)]
        out.append((i, i + step))
    overfull = []
    for s, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        rows = np.arange(s, s + size)
        rows = rows[np.argsort(n[rows], kind="stable")]
        heads, fresh = rows[early[rows]], rows[~old[rows]]
        apart = len(fresh) > most and not old[heads].all()
        if apart:
            overfull.append(segment[s])
        for low in range(0, len(heads), 256):
            h = heads[low : low + 256]
            near = rows[np.searchsorted(n[rows], t * n[h[0]] - S.EPS) : np.searchsorted(n[rows], n[h[-1]] / t + S.EPS, "right")]
            for at in range(0, len(near), 4096):
                i, j = (x.ravel() for x in np.broadcast_arrays(h[:, None], near[None, at : at + 4096]))
                ok = (i != j) & ~(early[j] & (i > j)) & alike(i, j)
                if apart:
                    ok &= old[i] | old[j]
                out.append((i[ok], j[ok]))
    i, j = (np.concatenate([p[k] for p in out]) if out else np.empty(0, np.int64) for k in (0, 1))
    swap = old[i]  # the new row first
    return np.where(swap, j, i), np.where(swap, i, j), np.array(overfull, np.int64)


def _met(postings: DataFrame, t: float, most: int) -> DataFrame:
    """(a, b, kind) of (segment, key, meta), each segment in one partition: kind 0 for two new rows, 1 for b old, 2 for an overfull segment a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, found = 0, []

        def work(x: np.ndarray) -> None:
            i, j, full = meetings(*x, t, most)
            a, b, kind = x[1][i], x[1][j], (x[2][j] & _OLD != 0).astype(np.int64)
            flip = (kind == 0) & (a > b)
            pairs = np.stack((np.where(flip, b, a), np.where(flip, a, b), kind))
            found.append(np.concatenate((pairs[:, a != b], np.stack((full, full, np.full(len(full), 2)))), axis=1))

        def distinct() -> pa.RecordBatch:
            x = np.concatenate(found, 1) if found else np.empty((3, 0), np.int64)
            x = x[:, np.lexsort(x)]
            x = x[:, np.r_[True, (x[:, 1:] != x[:, :-1]).any(0)]] if x.shape[1] else x
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["a", "b", "kind"])

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size < _FLUSH:
                continue
            x = np.concatenate(held, 1)
            last = int(np.searchsorted(x[0], x[0][-1]))  # the last segment may go on in the next batch
            if last:
                work(x[:, :last])
            held, size = [x[:, last:]], x.shape[1] - last
            if sum(f.shape[1] for f in found) > 1_000_000:
                yield distinct()
                found = []
        if size:
            work(np.concatenate(held, 1))
        yield distinct()

    return postings.sortWithinPartitions("segment").mapInArrow(run, "a bigint, b bigint, kind bigint").distinct()


def _decide(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, accepted) of rows(key, ord, id, cls) by the order: first come, first accepted.

    A group (rows of one id, or of one set cls) can hold one accepted row at
    most; links(x, y), both ways, are between sets.  A round accepts the rows
    that no undecided or accepted row precedes in any of their groups and
    rejects those that an accepted one precedes.
    """
    state = rows.select("*", F.lit(None).cast("boolean").alias("accepted"))
    for _ in range(MAX_ROUNDS):
        def first(by: str, s: DataFrame = state) -> DataFrame:
            took, open_ = (F.min(F.when(c, F.col("ord"))) for c in (F.col("accepted"), F.col("accepted").isNull()))
            return s.where(F.col(by).isNotNull()).groupBy(by).agg(took.alias("took"), open_.alias("open"))

        by_id, by_set = first("id"), first("cls")
        near = by_set.withColumnRenamed("cls", "x").join(links, "x").groupBy("y").agg(F.min("took").alias("took"), F.min("open").alias("open"))
        # A set's own first rows and its neighbours' together.
        about = by_set.unionByName(near.withColumnRenamed("y", "cls")).groupBy("cls").agg(F.min("took").alias("ctook"), F.min("open").alias("copen"))
        x = state.join(by_id.select("id", F.col("took").alias("itook"), F.col("open").alias("iopen")), "id", "left").join(about, "cls", "left")
        before = lambda c: F.coalesce(F.col(c) < F.col("ord"), F.lit(False))
        verdict = F.when(before("itook") | before("ctook"), False).when(~before("iopen") & ~before("copen"), True)
        after = scratch.save(x.select("key", "ord", "id", "cls", F.coalesce("accepted", verdict).alias("accepted")), "state")
        scratch.drop(state)
        state = after
        if state.where("accepted is null").isEmpty():
            return state.select("key", "accepted")
    raise RuntimeError(f"rows are undecided after {MAX_ROUNDS} rounds")


class Index:
    """What has been accepted, kept in a folder: segments, sets and ids, batch by batch.

    Opened at a folder that holds one already, it goes on from there; other
    parameters than it was made with are an error.  A batch reads the index and
    its own rows, never the accepted texts.  One writer at a time: a second one
    that commits the same batch number fails.

    The order of the shingles follows their counts in the rows seen when it was
    last fixed.  Any order is exact; once the rows have grown to ``GROW`` times as
    many, the counts are taken anew from the stored sets and the segments are
    written again in the new order, so the work of doing so stays in proportion
    to the rows.

    buckets: of the segments; the session's shuffle partitions where not given.
    most: new rows that share a segment and are still compared with one another
    at once; beyond it a batch is taken in several stretches of its order, the
    later ones after what the earlier ones accepted.
    """

    def __init__(self, spark: SparkSession, path: str, texts: list[str], id_column: str, t: float, k: int, min_words: int = 20, buckets: int | None = None, most: int = MOST):
        self.spark, self.texts, self.id_column, self.t, self.k, self.min_words, self.most = spark, texts, id_column, t, k, min_words, most
        self.folder = Folder(spark, path)
        self.path = self.folder.path
        own = {"texts": texts, "id_column": id_column, "t": t, "k": k, "min_words": min_words}
        if self.folder.exists("parameters.json"):
            stored = json.loads(self.folder.read("parameters.json"))
            self.buckets = stored.pop("buckets")
            if stored != own:
                raise ValueError(f"the index at {path} was made with {stored}, not {own}")
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.folder.write("parameters.json", json.dumps(own | {"buckets": self.buckets}))

    def commits(self) -> list[tuple[str, str, int]]:
        """(part, generation, rows) of every committed batch, in their order."""
        names = sorted(n.split(".") for n in self.folder.names("commits"))
        return [(part, generation, int(rows)) for _, part, generation, rows in names]

    def _commit(self, number: int, part: str, generation: str, rows: int) -> None:
        name = f"commits/{number:06d}.{part}.{generation}.{rows}"
        self.folder.write(name, "")
        if sum(n.startswith(f"{number:06d}.") for n in self.folder.names("commits")) > 1:
            self.folder.delete(name)
            raise RuntimeError(f"another writer has committed batch {number} to {self.path}")

    def segment_table(self, generation: str) -> str:
        """The name of the bucketed table over a generation's folder; an external table, so the name may go and come."""
        name = f"lacuna_segments_{generation}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (segment BIGINT, key BIGINT, meta BIGINT, part STRING) USING parquet "
            f"CLUSTERED BY (segment) INTO {self.buckets} BUCKETS LOCATION '{self.path}/segments/{generation}'"
        )
        return name

    def _sets(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(_SETS).parquet(*[f"{self.path}/sets/{p}" for p in parts])

    def accepted(self, parts: list[str]) -> DataFrame:
        """(key, id, cls) of the accepted rows; cls is the key that stands for the row's set."""
        if not parts:
            return self.spark.createDataFrame([], _IDS)
        return self.spark.read.schema(_IDS).parquet(*[f"{self.path}/ids/{p}" for p in parts])

    def _store(self, sets: DataFrame, generation: str, part: str, counts: np.ndarray) -> None:
        rows = segments(sets, counts, self.t).repartition(self.buckets, "segment")
        rows.select("segment", "key", "meta", F.lit(part).alias("part")).write.insertInto(self.segment_table(generation))

    def _counts(self, generation: str) -> np.ndarray:
        return np.frombuffer(bytes(self.spark.read.parquet(f"{self.path}/counts/{generation}").first()["counts"]), np.uint32)

    def _save_counts(self, generation: str, counts: np.ndarray) -> None:
        self.spark.createDataFrame([(bytearray(counts.tobytes()),)], "counts binary").coalesce(1).write.parquet(f"{self.path}/counts/{generation}")

    def _regrown(self, done: list[tuple[str, str, int]], more: int) -> tuple[str | None, bool]:
        """(the generation to write to, whether it has to be made anew)."""
        if not done:
            return None, True
        generation = done[-1][1]
        first = next(i for i, c in enumerate(done) if c[1] == generation)
        counted, rows = sum(c[2] for c in done[: first + 1]), sum(c[2] for c in done)
        return generation, rows + more >= GROW * max(counted, 1)

    def add(self, batch: DataFrame, key: str, order: list[Column]) -> DataFrame:
        """(key, accepted) for every row of a batch, taken in ``order`` after all rows of the index; the accepted ones are in it afterwards.

        A row is accepted unless a row accepted before has its id or a likeness of
        at least t.  The id column holds ids in comparable form; a null id equals
        none.  Rows below ``min_words`` words (null and empty texts too) are like
        no other and can only repeat an id.  key must be a unique bigint, in all
        batches together; rows with a null key are left out.  Rows equal in
        ``order`` follow their key.  An empty batch gives an empty result;
        columns of other names are not read.
        """
        ship(self.spark)
        scratch = Scratch(self.spark, "history")
        done = self.commits()
        old_parts = [p for p, _, _ in done]
        part = uuid.uuid4().hex
        texts = [F.col(c).alias(f"t{i}") for i, c in enumerate(self.texts)]
        rows = batch.select(F.col(key).cast("long").alias("key"), *texts).where("key is not null")
        cols = [f"t{i}" for i in range(len(self.texts))]
        width = G.counters(rows) if not done else 0
        G.signed(rows, "key", cols, self.k, self.min_words, width, sets=True).write.parquet(f"{self.path}/sets/{part}")
        stored = self._sets([part])
        mine = stored.where("block is null")
        more = mine.select("key").count()
        generation, anew = self._regrown(done, more)
        if generation is None:
            generation = part
            counts = G.total_counts(stored, width)
            self._save_counts(generation, counts)
        elif anew:
            generation, counts = self._regenerate(old_parts + [part], old_parts, part)
        else:
            counts = self._counts(generation)
        same = G.classes(mine.select("key", "n", "d1", "d2"), scratch)
        self._store(G.without(mine.select("key", "shingles"), "key", same.where("key != rep").select("key")), generation, part, counts)

        facts = batch.select(F.col(key).cast("long").alias("key"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("last")).alias("ord"), F.col(self.id_column).cast("string").alias("id")).where("key is not null")
        facts = facts.join(same, "key", "left").select("key", "ord", "id", F.coalesce("rep", "key").alias("cls"), F.col("rep").isNotNull().alias("copied"))
        out = self._screened(facts, generation, part, old_parts, scratch)
        ids = facts.join(out.where("accepted"), "key", "left_semi").select("key", "id", "cls")
        ids.write.parquet(f"{self.path}/ids/{part}")
        self._commit(len(done), part, generation, more)
        scratch.release()
        return out.withColumnRenamed("key", key)

    def _regenerate(self, parts: list[str], old_parts: list[str], part: str) -> tuple[str, np.ndarray]:
        """A new generation of segments for the accepted rows, in the order of the counts of all rows seen."""
        sets = self._sets(parts).where("block is null")
        width = G.counters(sets)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(width, np.uint32)
            for batch in batches:
                counts += np.bincount(S.slot(G._elements(batch.column(0))[0] << np.uint64(64 - S.HASH_BITS), width), minlength=width).astype(np.uint32)
            yield G.payloads(counts)

        counts = G.total_counts(sets.select("shingles").mapInArrow(run, "block int, payload binary"), width)
        self._save_counts(part, counts)
        for p in old_parts:
            self._store(self._sets([p]).where("block is null").join(self.accepted([p]).select(F.col("cls").alias("key")).distinct(), "key", "left_semi"), part, p, counts)
        return part, counts

    def _posted(self, generation: str, part: str, old_parts: list[str], roles: DataFrame | None) -> DataFrame:
        """(segment, key, meta) of the batch and of what it is compared with; roles: (key, old) of the batch's sets that take part, else all as new ones."""
        table = self.spark.table(self.segment_table(generation)).where(F.col("part").isin(old_parts + [part]))
        old = F.col("part") != part
        if roles is not None:
            table = table.join(roles, "key", "left").where(old | F.col("old").isNotNull())
            old = old | F.col("old")
        return table.select("segment", "key", F.when(old, F.col("meta").bitwiseOR(F.lit(_OLD))).otherwise(F.col("meta")).alias("meta"))

    def _screened(self, facts: DataFrame, generation: str, part: str, old_parts: list[str], scratch: Scratch) -> DataFrame:
        """(key, accepted) of facts(key, ord, id, cls, copied)."""
        sets = self._sets(old_parts + [part]).where("block is null")
        posted, before, taken, todo, out = self._posted(generation, part, old_parts, None), self.accepted(old_parts), None, facts, None
        for _ in range(MAX_ROUNDS):
            met = scratch.save(_met(posted, self.t, self.most), "met")
            now, full = todo, met.where("kind = 2").select(F.col("a").alias("segment"))
            if not full.isEmpty():
                now = scratch.save(self._stretch(todo, full, generation, part), "stretch")
                met = scratch.save(_met(self._posted(generation, part, old_parts, self._roles(now, taken)), self.t, self.most), "met")
            result = self._round(now, met, before, bool(old_parts) or taken is not None, sets, scratch)
            out = result if out is None else scratch.save(out.unionByName(result), "decided")
            if now is todo:
                return out
            fresh = now.join(result.where("accepted"), "key", "left_semi").select("key", "id", "cls")
            taken = scratch.save(fresh if taken is None else taken.unionByName(fresh), "taken")
            before = self.accepted(old_parts).unionByName(taken)
            todo = scratch.save(todo.join(now.select("key"), "key", "left_anti"), "todo")
            posted = self._posted(generation, part, old_parts, self._roles(todo, taken))
        raise RuntimeError(f"rows are undecided after {MAX_ROUNDS} stretches")

    def _roles(self, rows: DataFrame, taken: DataFrame | None) -> DataFrame:
        """(key, old) of the sets of rows, and of those taken before in this batch as old ones."""
        new = rows.select(F.col("cls").alias("key"), F.lit(False).alias("old"))
        if taken is not None:
            new = new.unionByName(taken.select(F.col("cls").alias("key"), F.lit(True).alias("old")))
        return new.groupBy("key").agg(F.max("old").alias("old"))

    def _stretch(self, todo: DataFrame, full: DataFrame, generation: str, part: str) -> DataFrame:
        """The rows up to the first place in the order at which a segment is full."""
        table = self.spark.table(self.segment_table(generation)).where(F.col("part") == part)
        at = table.join(full, "segment", "left_semi").select("segment", F.col("key").alias("cls")).join(todo.select("cls", "ord"), "cls")
        nth = F.row_number().over(Window.partitionBy("segment").orderBy("ord"))  # Spark keeps no more than ``most`` rows a task
        ends = at.withColumn("nth", nth).where(F.col("nth") <= self.most).groupBy("segment").agg(F.max("ord").alias("end"), F.max("nth").alias("nth"))
        end = ends.where(F.col("nth") == self.most).agg(F.min("end").alias("end"))
        return todo.join(F.broadcast(end), F.col("ord") <= F.col("end")).drop("end")  # one row

    def _round(self, rows: DataFrame, met: DataFrame, before: DataFrame, past: bool, sets: DataFrame, scratch: Scratch) -> DataFrame:
        """(key, accepted) of rows, given the pairs that may be alike and the rows accepted before."""
        pairs = met.where("kind = 0")
        if past:
            kept = before.select(F.col("cls").alias("b")).distinct()
            pairs = scratch.save(pairs.unionByName(met.where("kind = 1").join(kept, "b", "left_semi")), "pairs")
        ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        close = scratch.save(G.within_reach(pairs, G.only(sets.select("key", "n", *G.PRINTS), "key", ends(pairs)), self.t, ("kind",)), "close")
        alike = scratch.save(G.verified(close, G.only(sets.select("key", "shingles"), "key", ends(close)), self.t, ("kind",)), "alike")
        new = alike.where("kind = 0")
        links = scratch.save(new.select("a", "b").unionByName(new.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("x", "y"), "links")
        spent = None
        if past:  # rows that repeat what was accepted take no part in the batch's order
            like = rows.join(alike.where("kind = 1").select(F.col("a").alias("cls")).unionByName(before.select("cls")).distinct(), "cls", "left_semi").select("key")
            known = rows.join(before.where("id is not null").select("id").distinct(), "id", "left_semi").select("key")
            spent = scratch.save(like.unionByName(known).distinct(), "spent")
        # Only rows that share an id, a set or a link with others need an order.
        ids = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("shared"))
        linked = links.select(F.col("x").alias("cls")).distinct().withColumn("linked", F.lit(True))
        contested = rows.join(ids, "id", "left").join(linked, "cls", "left").where("shared or linked or copied").select("key", "ord", "id", "cls")
        if spent is not None:
            contested = contested.join(spent, "key", "left_anti")
        decided = _decide(scratch.save(contested, "contested"), links, scratch)
        out = rows.select("key").join(decided, "key", "left")
        if spent is not None:
            out = out.join(spent.withColumn("spent", F.lit(True)), "key", "left").select("key", F.when(F.col("spent"), False).otherwise(F.col("accepted")).alias("accepted"))
        return scratch.save(out.select("key", F.coalesce("accepted", F.lit(True)).alias("accepted")), "decided")


def screen(batch: DataFrame, key: str, id_column: str, texts: list[str], order: list[Column], t: float = 0.8, k: int = 5, min_words: int = 20, most: int = MOST) -> DataFrame:
    """(key, accepted) for every row of one table on its own, by an index that is made for it; see Index.add."""
    scratch = Scratch(batch.sparkSession, "screen")
    return Index(batch.sparkSession, f"{scratch.root}/index", texts, id_column, t, k, min_words, most=most).add(batch, key, order)
