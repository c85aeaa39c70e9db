"""Near-duplicate pairs through vantage-point trees over Hamming fingerprints.

Fingerprints are odd sketches, so the Hamming distance of two rows never
exceeds the number of shingles in which they differ, and a likeness bound turns
into a Hamming radius without false negatives.

At likeness 0.7 the radius (46 bits for 132 shingles) is too near the distance
of unrelated rows (63 of 128 bits) for triangle bounds to prune a tree over the
whole collection.  Rows are therefore first sharded by the rare shingles of
which a partner must hold at least one; a tree is built in each shard.  A shard
that may be large is cut by Hamming distance to a vantage point of its own into
rings, rings into blocks, and a row visits every ring that its radius overlaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm import shingles as S
from lacuna.llm import signatures as G
from lacuna.plans.runtime import Scratch, ship

LEAF = 16
LARGE_SHARD = 20_000
RING = 16
_SELF = 2
_FLUSH = 60_000


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1).astype(np.int64)


class Tree:
    """A vantage-point tree; ``visited`` counts the distances that queries computed."""

    def __init__(self, prints: np.ndarray, items: np.ndarray | None = None):
        self.prints, self.visited = prints, 0
        self.root = self._build(np.arange(len(prints)) if items is None else items)

    def _build(self, items: np.ndarray):
        if len(items) <= LEAF:
            return items
        vantage, rest = items[0], items[1:]
        d = hamming(self.prints[rest], self.prints[vantage])
        mu = int(np.median(d))
        inner = d <= mu
        if inner.all():  # all at or within one distance: no ball parts them
            half = np.zeros(len(rest), bool)
            half[: len(rest) // 2] = True
            return vantage, -1, self._build(rest[half]), self._build(rest[~half])
        return vantage, mu, self._build(rest[inner]), self._build(rest[~inner])

    def within(self, prints: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, item) of all pairs with distance <= the query's radius."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(prints)))]
        while todo:
            node, queries = todo.pop()
            if not len(queries):
                continue
            if isinstance(node, np.ndarray):
                d = hamming(prints[queries][:, None], self.prints[node][None])
                self.visited += d.size
                q, i = np.nonzero(d <= radii[queries][:, None])
                found.append((queries[q], node[i]))
                continue
            vantage, mu, inner, outer = node
            d = hamming(prints[queries], self.prints[vantage])
            self.visited += d.size
            hit = queries[d <= radii[queries]]
            found.append((hit, np.full(len(hit), vantage)))
            if mu < 0:
                todo += [(inner, queries), (outer, queries)]
            else:  # triangle bounds: an item within r of the query lies within r of the query's distance
                todo += [(inner, queries[d - radii[queries] <= mu]), (outer, queries[d + radii[queries] > mu])]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _accept(a: np.ndarray, b: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, fp: np.ndarray, t: float) -> np.ndarray:
    """Which of the row pairs may have a likeness of t: by size, place of the shared shingle and fingerprint."""
    na, nb = n[a], n[b]
    common = np.ceil(t / (1 + t) * (na + nb) - S.EPS)
    ok = (np.minimum(na, nb) >= t * np.maximum(na, nb) - S.EPS) & (np.minimum(na - pos[a], nb - pos[b]) >= common)
    ok &= ((side[a] == _SELF) & (side[b] == _SELF)) | (side[a] + side[b] == 1)
    i = np.flatnonzero(ok)
    ok[i] = hamming(fp[a[i]], fp[b[i]]) <= S.radius(na[i], nb[i], t)
    return ok


def pairs_in_shards(cell: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, fp: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the row pairs of one shard that may be alike; rows are sorted by shard."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    small = np.repeat(sizes <= LEAF, sizes)
    for step in range(1, min(LEAF, int(sizes.max(initial=0)))):  # leaves: all shards at once
        i = np.flatnonzero(small[:-step] & (cell[:-step] == cell[step:]))
        if not len(i):
            break
        i = i[_accept(i, i + step, n, pos, side, fp, t)]
        out.append((i, i + step))
    reach = np.floor((1 - t) / t * n + S.EPS).astype(np.int64)  # the radius towards the largest partner
    for s, size in zip(starts[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        rows = np.arange(s, s + size)
        base = rows[side[rows] != 1]
        ask = rows if (side[rows] == _SELF).any() else rows[side[rows] == 1]
        q, i = Tree(fp, base).within(fp[ask], reach[ask])
        q = ask[q]
        keep = (q < i) | (side[q] == 1)
        q, i = q[keep], i[keep]
        ok = _accept(q, i, n, pos, side, fp, t)
        out.append((q[ok], i[ok]))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def _shards(s: np.ndarray, row: np.ndarray, n: np.ndarray, pos: np.ndarray, fp: np.ndarray, count: np.ndarray, large: int, t: float):
    """(index of the posting, shard, side): one shard a posting, or several where the shingle may be in many rows.

    Such a shard is cut.  Of a pair, the smaller row holds the shingle in the
    short prefix that is enough against sets not smaller; only these postings
    stand in the cut shard, in one cell each, and all of them ask in every cell
    that their radius overlaps.  Rows that hold a common shingle late, as texts
    made from a template do, therefore never meet over it.
    """
    at = np.arange(len(s))
    cell, side = s.view(np.int64).copy(), np.full(len(s), _SELF, np.int64)
    hot = np.flatnonzero(count > large)
    if not len(hot):
        return at, cell, side
    keep = count <= large
    prints, size = fp[row[hot]], n[row[hot]]
    vantage = np.stack((S.mix(s[hot]), S.mix(s[hot] ^ np.uint64(0x5851F42D4C957F2D))), axis=1)
    blocks = -(-count[hot].astype(np.int64) // large)
    d = hamming(prints, vantage)
    place = lambda posting, ring, block: S.mix(s[hot][posting] ^ S.mix(ring.astype(np.uint64) << np.uint64(32) | block.astype(np.uint64))).view(np.int64)
    early = np.flatnonzero(pos[hot] < S.short_prefix_len(size, t))
    mine = place(early, d[early] // RING, (S.mix(prints[early, 0]) % blocks[early].astype(np.uint64)).astype(np.int64))
    reach = np.floor((1 - t) / t * size + S.EPS).astype(np.int64)
    low, high = np.maximum(0, d - reach) // RING, np.minimum(128, d + reach) // RING
    cells = (high - low + 1) * blocks
    ask = np.repeat(np.arange(len(hot)), cells)
    no = np.arange(len(ask)) - np.repeat(np.cumsum(cells) - cells, cells)
    asked = place(ask, low[ask] + no // blocks[ask], no % blocks[ask])
    zero, one = np.zeros(len(early), np.int64), np.ones(len(ask), np.int64)
    return np.concatenate((at[keep], hot[early], hot[ask])), np.concatenate((cell[keep], mine, asked)), np.concatenate((side[keep], zero, one))


def candidate_pairs(reps: DataFrame, key: str, texts: list[str], counts: np.ndarray, k: int, t: float, min_words: int, large: int = LARGE_SHARD) -> DataFrame:
    """(a, b), a < b: pairs of rows that may have a likeness of at least t; none that has is missing.

    key must be a bigint.  large: shingles that may be in more rows than this
    (by the counts, which never understate) have their shard cut.
    """
    spark = reps.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(counts)
    large = max(large, 4 * int(counts.mean()))
    schema = "cell bigint, key bigint, meta bigint, f0 bigint, f1 bigint"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = shared.value
        for batch in batches:
            for at, part in G._parts(batch, 1):
                s, ends = S.shingle_sets(part, k, min_words)
                fp = S.odd_sketch(s, ends)
                s, row, pos, n = S.ranked_prefixes(s, ends, count, t)
                p, cell, side = _shards(s, row, n, pos, fp, count[S.slot(s, len(count))], large, t)
                row, pos = row[p], pos[p]
                keys = batch.column(0).to_numpy(zero_copy_only=False)[at + row]
                meta = n[row] << 32 | pos << 2 | side
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, keys, meta, fp[row, 0].view(np.int64), fp[row, 1].view(np.int64))], names=["cell", "key", "meta", "f0", "f1"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, found, many = 0, [], 0

        def work(x: np.ndarray) -> None:
            meta = x[2]
            fp = np.ascontiguousarray(x[3:5].T).view(np.uint64)
            i, j = pairs_in_shards(x[0], meta >> 32, (meta & 0xFFFFFFFF) >> 2, meta & 3, fp, t)
            a, b = x[1][i], x[1][j]
            keep = a != b
            found.append(np.stack((np.minimum(a, b)[keep], np.maximum(a, b)[keep])))

        def distinct() -> np.ndarray:
            return np.unique(np.concatenate(found, 1), axis=1) if found else np.empty((2, 0), np.int64)

        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            size += batch.num_rows
            if size < _FLUSH:
                continue
            x = np.concatenate(held, 1)
            last = int(np.searchsorted(x[0], x[0][-1]))  # the last shard may go on in the next batch
            if last:
                work(x[:, :last])
            held, size = [x[:, last:]], x.shape[1] - last
            many = sum(f.shape[1] for f in found)
            if many > 2_000_000:
                u = distinct()
                found = [u]
                if u.shape[1] > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])
                    found = []
        if size:
            work(np.concatenate(held, 1))
        u = distinct()
        yield pa.RecordBatch.from_arrays([pa.array(u[0]), pa.array(u[1])], names=["a", "b"])

    posted = reps.select(F.col(key).cast("long").alias("key"), *texts).mapInArrow(post, schema)
    return posted.repartition("cell").sortWithinPartitions("cell").mapInArrow(match, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, key: str, texts: list[str], t: float = 0.8, k: int = 5, min_words: int = 20, large: int = LARGE_SHARD) -> tuple[DataFrame, DataFrame]:
    """(pairs, classes) of the rows whose word-shingle likeness is at least t.

    classes: (key, rep) for rows that share their whole set with others, with the
    smallest key.  pairs: (a, b, likeness) of different sets, a < b, each set by
    its smallest key.  Together they hold every link; copies are not expanded.
    key must be a unique bigint; rows with a null key, and rows of fewer than
    ``min_words`` words (null and empty texts too), have no links.  An empty df
    gives empty results; columns of other names are not read.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    rows = df.select(F.col(key).cast("long").alias("key"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(texts)]).where("key is not null")
    texts = [f"t{i}" for i in range(len(texts))]
    digests, counts = G.first_pass(rows, "key", texts, scratch, k, min_words)
    same = G.classes(digests, scratch)
    reps = G.without(rows, "key", same.where("key != rep").select("key"))
    pairs = scratch.save(candidate_pairs(reps, "key", texts, counts, k, t, min_words, large), "pairs")
    touched = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    sets = scratch.save(G.set_table(G.only(rows, "key", touched), "key", texts, k, min_words), "sets")
    return scratch.save(G.verified(pairs, sets, t), "links"), same


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(seq_a, seq_b): all row pairs of the links between and within classes."""
    c = classes.select("rep", "key")
    x = pairs.select("a", "b").join(c.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a", "left")
    x = x.join(c.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b", "left").select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"))
    within = c.withColumnRenamed("key", "x").join(c.withColumnRenamed("key", "y"), "rep").where("x < y").select("x", "y")
    return x.unionByName(within).select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
