"""Long exact spans shared between texts, by content-defined chunks.

Texts are cut into chunks by a gear rolling hash (see gear.py); chunks meet by
their digest.  Two texts with ``span`` characters in common share a whole chunk,
so chunk digests found in one text only are done with.  Of the others

* a digest of few texts gives the text pairs, with the place of the chunk in
  each; chunks on one diagonal that touch add up, and where they reach ``span``
  the characters there are compared; the other pairs are compared by their texts;
* a digest of many texts (boilerplate) is parted by what stands before and after
  the chunk, and, where that is common too, by every stretch of ``span``
  characters around it (by 128 bits of hash).  What shares such a stretch is a
  pair; nothing that merely shares the boilerplate is ever paired up.

How often a digest, side or stretch occurs is counted before anything is brought
together by it, and the counts are joined back, so a line that stands in every
text is no task of its own.

Exact copies are reduced to one text first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.llm import gear
from lacuna.llm import signatures as G
from lacuna.llm.shingles import mix
from lacuna.plans import slots
from lacuna.plans.runtime import Scratch, ship

SPAN = 200
LARGE = 64
_BATCH_CHARS = 500_000


def _batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for stop in range(1, len(texts) + 1):
        size += len(texts[stop - 1])
        if size >= _BATCH_CHARS or stop == len(texts):
            yield at, texts[at:stop]
            at, size = stop, 0


def _context(sums: np.ndarray, back: np.ndarray, lo: np.ndarray, hi: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """32-bit hashes of [lo, hi); 0 where not ok."""
    lo, hi = np.where(ok, lo, 0), np.where(ok, hi, 0)
    with np.errstate(over="ignore"):
        h = mix((sums[hi] - sums[lo]) * back[lo]) >> np.uint64(32)
    return np.where(ok, np.maximum(h, np.uint64(1)), np.uint64(0))


def _prefix_hash(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(cps)
    with np.errstate(over="ignore"):
        power = np.full(n, gear._B)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        back = np.full(n + 1, gear._B_INV)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        g = mix(cps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(g * power))), back


def postings(docs: DataFrame, span: int) -> DataFrame:
    """(digest, doc, start, len, before, after) of every chunk of docs(doc, text).

    before, after: hashes of the half of the missing length on either side; 0
    where the text ends earlier.  Of a shared span one half at least is whole.
    """
    window, least = gear.sizes_for(span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for at, part in _batches(batch.column(1).to_pylist()):
                cps, ends = gear.code_points(part)
                digest, row, start, size = gear.chunks(cps, ends, window, least)
                sums, back = _prefix_hash(cps)
                first = np.r_[0, ends[:-1]][row]
                lo, hi, half = first + start, first + start + size, (span - size + 1) // 2
                left = _context(sums, back, lo - half, lo, (half > 0) & (start >= half))
                right = _context(sums, back, hi, hi + half, (half > 0) & (hi + half <= ends[row]))
                ctx = left << np.uint64(32) | right
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (digest.view(np.int64), ids[at + row], start << 20 | size, ctx.view(np.int64))], names=["digest", "doc", "place", "ctx"])

    raw = docs.mapInArrow(run, "digest bigint, doc bigint, place bigint, ctx bigint")
    return raw


def _unpacked(p: DataFrame) -> DataFrame:
    return p.select("*", F.shiftright("place", 20).alias("start"), F.col("place").bitwiseAND((1 << 20) - 1).alias("len"), F.shiftrightunsigned("ctx", 32).alias("before"), F.col("ctx").bitwiseAND(0xFFFFFFFF).alias("after"))


def _joined(p: DataFrame, key: str, same: str) -> DataFrame:
    """(a, b, shift, lo, hi): occurrences of one key in two texts; lo and hi in text a."""
    x = p.select(key, F.col("doc").alias("a"), F.col("start").alias("sa"), F.col("len").alias("la"), F.col("before").alias("ba"), F.col("after").alias("aa"))
    y = p.select(key, F.col("doc").alias("b"), F.col("start").alias("sb"), F.col("len").alias("lb"), F.col("before").alias("bb"), F.col("after").alias("ab"))
    return x.join(y, key).where(f"a < b and la = lb and {same}").selectExpr("a", "b", "sb - sa as shift", "sa as lo", "sa + la as hi")


_EITHER = "((ba = bb and ba != 0) or (aa = ab and aa != 0) or la >= {span})"


def _repeated(rows: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """The written rows whose key occurs more than once, with its number ``n``."""
    counts = scratch.save(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    some = slots.flag(rows, key, slots.bitmap_of(counts, key), "maybe_there").where("maybe_there").drop("maybe_there")
    return some.join(counts, key)


def _stretches(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """(stretch, check, doc, at): two hashes and the places of all stretches of ``span`` characters that hold a wanted (doc, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cps = gear.code_points([text])[0]
                start, size = np.array(places) >> 20, np.array(places) & ((1 << 20) - 1)
                inside = np.zeros(len(cps) - span + 2, np.int64)  # where a stretch may begin, as steps up and down
                np.add.at(inside, np.maximum(0, start + size - span), 1)
                np.add.at(inside, np.minimum(start, len(cps) - span) + 1, -1)
                at = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
                h, check = gear.windows(cps, span)[at], gear.windows(cps ^ np.uint32(0x5BD1E995), span)[at]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(at)], names=["stretch", "check", "doc", "at"])

    places = wanted.groupBy("doc").agg(F.collect_set("place").alias("places"))  # of one text: no more than its own chunks
    rows = G.only(docs, "doc", wanted.select(F.col("doc").alias("key")).distinct()).join(places, "doc")
    return rows.select("doc", "text", "places").mapInArrow(run, "stretch bigint, check bigint, doc bigint, at bigint")


def shared_intervals(a: str, b: str, span: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of a and of b that lie in common stretches of ``span`` characters or more."""
    ca, cb = gear.code_points([a])[0], gear.code_points([b])[0]
    ha, hb = gear.windows(ca, span), gear.windows(cb, span)
    there = np.isin(ha, hb)
    back = np.isin(hb, ha)
    if there.any():  # hashes found them, characters decide
        texts = {b[i : i + span] for i in np.flatnonzero(back)}
        hits = np.array([i for i in np.flatnonzero(there) if a[i : i + span] in texts], np.int64)
        own = {a[i : i + span] for i in hits}
        return _merged(hits, span), _merged(np.array([i for i in np.flatnonzero(back) if b[i : i + span] in own], np.int64), span)
    return [], []


def _merged(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > span)
    return list(zip(starts[np.r_[0, gap + 1]].tolist(), (starts[np.r_[gap, len(starts) - 1]] + span).tolist(), strict=True))


def _compared(pairs: DataFrame, docs: DataFrame, scratch: Scratch, span: int) -> DataFrame:
    """(a, b, in_a, in_b): the pairs that share a stretch by their texts, with the merged parts in each."""
    touched = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = scratch.save(G.only(docs, "doc", touched), "texts")
    x = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        for batch in batches:
            rows, left, right = [], [], []
            for i, (p, q) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                in_a, in_b = shared_intervals(p, q, span)
                if in_a:
                    rows.append(i)
                    left.append([{"lo": s, "hi": e} for s, e in in_a])
                    right.append([{"lo": s, "hi": e} for s, e in in_b])
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(left, kind), pa.array(right, kind)], names=["a", "b", "in_a", "in_b"])

    part = "array<struct<lo:bigint,hi:bigint>>"
    return x.select("a", "b", "ta", "tb").mapInArrow(run, f"a bigint, b bigint, in_a {part}, in_b {part}")


def _longest(runs: Column) -> Column:
    """struct<size, lo> of the longest run of touching intervals of sorted array<struct<lo, hi>>."""

    def grow(acc: Column, r: Column) -> Column:
        lo = F.when(r.lo <= acc.hi, acc.lo).otherwise(r.lo)
        hi = F.when(r.lo <= acc.hi, F.greatest(acc.hi, r.hi)).otherwise(r.hi)
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.greatest(acc.best, F.struct((hi - lo).alias("size"), lo.alias("lo"))).alias("best"))

    none, zero = F.lit(-1).cast("long"), F.lit(0).cast("long")
    return F.aggregate(runs, F.struct(none.alias("lo"), none.alias("hi"), F.struct(zero.alias("size"), zero.alias("lo")).alias("best")), grow)["best"]


class SharedSpans:
    """Finds texts that share at least ``span`` characters.

    Texts are compared as stored.  Null, empty and shorter texts share nothing;
    equal texts of that length share themselves; several places of one text do
    not make a pair.  key must be a unique bigint; rows with a null key take no
    part; columns of other names are not read.  An empty df gives empty results.
    """

    def __init__(self, df: DataFrame, key: str, text: str, span: int = SPAN, large: int = LARGE):
        self.span, self.large = span, large
        self.scratch = Scratch(df.sparkSession, "spans")
        ship(df.sparkSession)
        self.rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where((F.length("text") >= span) & F.col("doc").isNotNull())
        digest = self.rows.select(F.col("doc").alias("key"), F.unhex(F.md5("text")).alias("d1"), F.xxhash64("text").alias("d2"), F.length("text").alias("n"))
        self.copies = G.classes(digest, self.scratch)
        self.docs = G.without(self.rows, "doc", self.copies.where("key != rep").select("key"))
        self._meet()

    def _meet(self) -> None:
        s, large, span = self.scratch, self.large, self.span
        met = _unpacked(s.save(_repeated(s.save(postings(self.docs, span), "postings"), "digest", s), "met"))
        either = _EITHER.format(span=span)
        found = [_joined(met.where(f"n <= {large}"), "digest", either)]
        # Many texts: by one side's surroundings, then by whole stretches.
        hot = met.where(f"n > {large}").drop("n")
        sides = hot.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("c")), F.struct(F.lit(1).alias("side"), F.col("after").alias("c")))).alias("x")).where("x.c != 0")
        sides = s.save(sides.withColumn("near", F.xxhash64("digest", "len", "x.side", "x.c")).drop("x"), "sides")
        sides = s.save(_repeated(sides, "near", s), "met-sides")
        found.append(_joined(sides.where(f"n <= {large}"), "near", either))
        wanted = s.save(sides.where(f"n > {large}").select("doc", "place").distinct(), "wanted")
        stretches = s.save(_stretches(self.rows, wanted, span), "stretches")
        common = s.save(stretches.groupBy("stretch", "check").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("stretch", "check"), "common")
        self.stretches = s.save(stretches.join(common, ["stretch", "check"]), "shared-stretches")
        # Stretches side by side mostly stand in the same texts: one of them stands for all.
        who = self.stretches.groupBy("stretch", "check", "doc").agg(F.lit(1).alias("one")).drop("one")
        same = [F.sum(F.xxhash64(F.lit(i), "doc").cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
        one = who.groupBy("stretch", "check").agg(F.count("*").alias("n"), *same).groupBy("n", "s1", "s2").agg(F.min(F.struct("stretch", "check")).alias("x")).select("x.*")
        who = s.save(who.join(one, ["stretch", "check"], "left_semi"), "who")
        self.by_stretch = who.withColumnRenamed("doc", "a").join(who.withColumnRenamed("doc", "b"), ["stretch", "check"]).where("a < b").select("a", "b").distinct()
        runs = found[0].unionByName(found[1]).groupBy("a", "b", "shift").agg(F.sort_array(F.collect_set(F.struct("lo", "hi"))).alias("runs"))
        self.candidates = s.save(runs.select("a", "b", _longest(F.col("runs")).alias("best"), "shift").groupBy("a", "b").agg(F.max(F.struct("best", "shift")).alias("x")).select("a", "b", F.col("x.best.size").alias("best"), F.col("x.best.lo").alias("lo"), F.col("x.shift").alias("shift")), "candidates")

    def rep_pairs(self) -> DataFrame:
        """(a, b), a < b: different texts that share a span, each by the smallest key of its copies."""
        sure = self.candidates.where(f"best >= {self.span}")
        texts = G.only(self.rows, "doc", sure.select(F.explode(F.array("a", "b")).alias("key")).distinct())
        part = lambda at: F.substring("text", at.cast("int") + 1, F.lit(self.span))
        x = sure.join(texts.withColumnRenamed("doc", "a"), "a").select("a", "b", "shift", "lo", part(F.col("lo")).alias("in_a"))
        x = x.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "b", (part(F.col("lo") + F.col("shift")) == F.col("in_a")).alias("equal"))
        sure = self.scratch.save(x, "sure")
        open_ = self.candidates.where(f"best < {self.span}").select("a", "b").unionByName(sure.where("not equal").select("a", "b"))
        rest = _compared(open_, self.rows, self.scratch, self.span)
        return self.scratch.save(sure.where("equal").select("a", "b").unionByName(self.by_stretch).unionByName(rest.select("a", "b")).distinct(), "pairs")

    def pairs(self) -> DataFrame:
        """(doc_a, doc_b): all pairs of rows that share a span, copies included."""
        c = self.copies.select("rep", "key")
        x = self.rep_pairs().join(c.select(F.col("rep").alias("a"), F.col("key").alias("ka")), "a", "left").join(c.select(F.col("rep").alias("b"), F.col("key").alias("kb")), "b", "left")
        x = x.select(F.coalesce("ka", "a").alias("x"), F.coalesce("kb", "b").alias("y"))
        within = c.withColumnRenamed("key", "x").join(c.withColumnRenamed("key", "y"), "rep").where("x < y").select("x", "y")
        return x.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))

    def coverage(self) -> DataFrame:
        """(doc, n_chars, shared_chars): how many characters of each text lie in spans that another text has too.

        Texts below the span length are not listed.  Boilerplate counts by its
        stretches, without pairing up the texts that hold it.
        """
        cmp = _compared(self.candidates.select("a", "b"), self.rows, self.scratch, self.span)
        parts = cmp.select(F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("in_a").alias("parts")), F.struct(F.col("b").alias("doc"), F.col("in_b").alias("parts")))).alias("x"))
        parts = parts.select("x.doc", F.explode("x.parts").alias("p"))
        parts = parts.unionByName(self.stretches.select("doc", F.struct(F.col("at").alias("lo"), (F.col("at") + self.span).alias("hi")).alias("p")))
        parts = parts.distinct().groupBy("doc").agg(F.sort_array(F.collect_list("p")).alias("parts"))
        start = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("sum"))
        step = lambda acc, r: F.struct(F.greatest(acc.hi, r.hi).alias("hi"), (acc["sum"] + F.greatest(F.lit(0), r.hi - F.greatest(acc.hi, r.lo))).alias("sum"))
        shared = parts.select("doc", F.aggregate("parts", start, step)["sum"].alias("in_parts"))
        sizes = self.rows.select("doc", F.length("text").cast("long").alias("n_chars"))
        whole = self.copies.select(F.col("key").alias("doc"), F.lit(True).alias("copied")).distinct()
        x = sizes.join(shared, "doc", "left").join(whole, "doc", "left")
        return x.select("doc", "n_chars", F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("in_parts", F.lit(0))).alias("shared_chars"))
