"""Survival of candidates under seeded perturbation.

A draw is a hash of seed, mode, replicate and what is drawn, so replicates need
no state, run in any order on any executor and come out the same in any engine.
What is perturbed is the candidate's sufficient statistic, never the graph.
An edge or paper is kept if its draw is at most the keep probability.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans.runtime import Scratch

MASK = 60  # replicates a number holds, one a bit


def replicates(df: DataFrame, repeats: int) -> DataFrame:
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(repeats))))


def _kept(seed: int, mode: str, item: Column, keep: float) -> Column:
    return _drawn(seed, mode, F.col("replicate"), item, keep)


def _drawn(seed: int, mode: str, replicate: Column, item: Column, keep: float) -> Column:
    """uniform(seed, mode, replicate, item) <= keep, by the digest's text: eight hexadecimal digits have the order of their number."""
    if keep < 0:
        return F.lit(False)
    most = min(math.floor(keep * 4294967296.0), 4294967295)
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(mode), replicate.cast("string"), item)), 1, 8) <= F.lit(f"{most:08x}")


def _mask(low: int, n: int, kept: Callable[[Column], Column]) -> Column:
    bit = lambda r: F.when(kept(r), F.call_function("shiftleft", F.lit(1).cast("bigint"), r - low)).otherwise(F.lit(0).cast("bigint"))
    return F.aggregate(F.sequence(F.lit(low), F.lit(low + n - 1)), F.lit(0).cast("bigint"), lambda a, r: a.bitwiseOR(bit(r)))


def _masks(repeats: int, kept: Callable[[Column], Column] | None) -> list[Column]:
    """m0, m1, ...: the replicates in which a row is kept (all, without kept) as bits, MASK of them a column."""
    spans = [(low, min(MASK, repeats + 1 - low)) for low in range(1, repeats + 1, MASK)]
    masks = [F.lit((1 << n) - 1).cast("bigint") if kept is None else _mask(low, n, kept) for low, n in spans]
    return [m.alias(f"m{i}") for i, m in enumerate(masks)]


def _yearly(masked: DataFrame, repeats: int) -> DataFrame:
    """(concept, replicate, year, papers) of (concept, year, paper, m0, m1, ...): distinct papers of a year in each replicate.

    A paper is one row however many replicates keep it; what is shuffled does not grow with their number.
    """
    names = [f"m{i}" for i in range(-(-repeats // MASK))]
    once = masked.where("year is not null").groupBy("concept", "year", "paper").agg(*[F.bit_or(m).alias(m) for m in names])
    bits = [F.sum(F.shiftright(names[(r - 1) // MASK], (r - 1) % MASK).bitwiseAND(F.lit(1).cast("bigint"))).alias(f"r{r}") for r in range(1, repeats + 1)]
    counts = once.groupBy("concept", "year").agg(*bits)
    each = F.array(*[F.struct(F.lit(r).alias("replicate"), F.col(f"r{r}").alias("papers")) for r in range(1, repeats + 1)])
    return counts.select("concept", "year", F.explode(each).alias("x")).select("concept", "x.replicate", "year", "x.papers").where("papers > 0")


def link_survival(items: DataFrame, mode: str, keep: float = 0.95, repeats: int = 50, seed: int = 42, min_paths: int = 1) -> DataFrame:
    """(head, tail, survival): share of replicates in which min_paths paths keep all of their items.

    items: (head, tail, path_no, item), as of paths.path_edges or paths.path_papers.
    """
    whole = replicates(items, repeats).groupBy("head", "tail", "replicate", "path_no").agg(F.every(_kept(seed, mode, F.concat_ws("|", "head", "tail", "item"), keep)).alias("whole"))
    runs = whole.groupBy("head", "tail", "replicate").agg(F.count_if("whole").alias("paths"))
    return runs.groupBy("head", "tail").agg((F.count_if(F.col("paths") >= min_paths) / F.lit(float(repeats))).alias("survival"))


def link_addition_survival(path_counts: DataFrame, plausible: DataFrame, probability: float = 0.5, repeats: int = 50, seed: int = 42, min_paths: int = 1) -> DataFrame:
    """(head, tail, survival): share of replicates in which no plausible direct edge (head, tail, item) is added and min_paths paths exist."""
    x = replicates(path_counts, repeats)
    p = plausible.withColumnRenamed("item", "i")
    j = x.join(p, ["head", "tail"], "left")
    hit = F.coalesce(_kept(seed, "add", F.concat_ws("|", "head", "tail", F.col("i").cast("string")), probability) & F.col("i").isNotNull(), F.lit(False))
    runs = j.groupBy("head", "tail", "paths", "replicate").agg(F.bool_or(hit).alias("closed"))
    return runs.groupBy("head", "tail").agg((F.count_if(~F.col("closed") & (F.col("paths") >= min_paths)) / F.lit(float(repeats))).alias("survival"))


def cluster_edges(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, a, b, inside): the edges in or at each community of (node, community)."""
    m = membership.toDF("node", "community")
    x = pairs.join(m.toDF("a", "ca"), "a", "left").join(m.toDF("b", "cb"), "b", "left")
    return x.select("a", "b", F.explode(F.array_distinct(F.filter(F.array("ca", "cb"), lambda c: c.isNotNull()))).alias("community"), F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("inside"))


def cluster_survival(edges: DataFrame, mode: str, keep: float = 0.95, repeats: int = 50, seed: int = 42, isolation: float = 0.9, sources: DataFrame | None = None) -> DataFrame:
    """(community, survival): share of replicates in which the cluster stays isolated (I16).

    edges: cluster_edges.  mode 'edge' keeps edges one by one; mode 'paper' keeps
    papers, and an edge while one of its papers is kept; sources are then the
    edges' papers as of paths.edge_papers.

    Cut edges are drawn first.  Without one that is kept the cluster stays
    isolated, with too many it does not even if every internal edge is kept;
    internal edges are drawn only for the replicates that are left.
    """
    scratch = Scratch(edges.sparkSession, "survival")
    name = F.col("community").cast("string")
    if mode == "edge":
        kept = _kept(seed, mode, F.concat_ws("|", name, F.concat_ws("~", "a", "b")), keep)
    else:  # an edge's papers in its row, so that no replicate of an edge travels
        edges = edges.join(sources.groupBy("a", "b").agg(F.collect_set("paper").alias("papers")), ["a", "b"], "left")
        kept = F.coalesce(F.exists("papers", lambda p: _kept(seed, mode, F.concat_ws("|", name, p), keep)), F.lit(False))
    edges = scratch.save(edges, "edges")
    stays = lambda internal: 1 - F.col("cut") / F.greatest(internal + F.col("cut"), F.lit(1)) >= isolation
    drawn = lambda x, to: x.where(kept).groupBy("community", "replicate").agg(F.count("*").alias(to))
    cut = drawn(replicates(edges.where(~F.col("inside")), repeats), "cut")
    runs = replicates(edges.groupBy("community").agg(F.count_if("inside").alias("most")), repeats).join(cut, ["community", "replicate"], "left").na.fill(0, ["cut"])
    runs = scratch.save(runs.withColumn("sure", F.when(stays(F.lit(0)), True).when(~stays(F.col("most")), False)), "runs")
    rest = runs.where("sure is null").groupBy("community").agg(F.collect_set("replicate").alias("open"))
    internal = drawn(edges.where("inside").join(rest, "community").withColumn("replicate", F.explode("open")), "internal")
    runs = runs.join(internal, ["community", "replicate"], "left").withColumn("stays", F.coalesce("sure", stays(F.coalesce("internal", F.lit(0)))))
    return runs.groupBy("community").agg((F.count_if("stays") / F.lit(float(repeats))).alias("survival"))


def cluster_addition_survival(edges: DataFrame, plausible: DataFrame, probability: float = 0.5, repeats: int = 50, seed: int = 42, isolation: float = 0.9) -> DataFrame:
    """(community, survival) with each plausible edge (community, item) across the border added by chance."""
    base = edges.groupBy("community").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("cut"))
    x = replicates(base, repeats).join(plausible, "community", "left")
    hit = F.coalesce(_kept(seed, "add", F.concat_ws("|", F.col("community").cast("string"), F.col("item").cast("string")), probability) & F.col("item").isNotNull(), F.lit(False))
    runs = x.groupBy("community", "internal", "cut", "replicate").agg(F.count_if(hit).alias("added"))
    cut = F.col("cut") + F.col("added")
    stays = 1 - cut / F.greatest(F.col("internal") + cut, F.lit(1)) >= isolation
    return runs.groupBy("community").agg((F.count_if(stays) / F.lit(float(repeats))).alias("survival"))


def incident(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(concept, edge_seq, year, paper): the relation events at each concept."""
    e = edges.select("edge_seq", "year", "source_paper", F.explode(F.array_distinct(F.array("u", "v"))).alias("concept"))
    return e.join(concepts.select("concept").distinct(), "concept").select("concept", "edge_seq", "year", F.coalesce("source_paper", F.concat(F.lit("event-"), F.col("edge_seq").cast("string"))).alias("paper"), F.col("source_paper").isNotNull().alias("has_paper"))


def gate_decay(events: DataFrame, publications: DataFrame, end_year: int | None, lookback: int = 2, by: tuple[str, ...] = ("concept",)) -> DataFrame:
    """(by, decay, active_years): the gate's own recomputation, clipped to 0..1.

    It ends in the concept's last active year or end_year, whichever is earlier.
    """
    return _declines(events.where("year is not null").groupBy(*by, "year").agg(F.count_distinct("paper").alias("papers")), publications, end_year, lookback, by)


def _declines(y: DataFrame, publications: DataFrame, end_year: int | None, lookback: int, by: tuple[str, ...]) -> DataFrame:
    """gate_decay of (by, year, papers)."""
    y = y.join(F.broadcast(publications), "year", "left")  # one row a year
    y = y.withColumn("rate", F.col("papers") / F.greatest(F.coalesce("publications", F.lit(0)), F.lit(1)))
    last = y.groupBy(*by).agg(F.max("year").alias("last"), F.count("*").alias("active_years"))
    last = last.withColumn("last", F.least("last", F.lit(end_year)) if end_year is not None else F.col("last"))
    x = y.join(last, list(by))
    ago = F.col("last") - F.col("year")
    window = lambda lo, hi: F.sum(F.when((ago >= lo) & (ago < hi), F.col("rate")).otherwise(0.0)) / max(lookback, 1)
    x = x.groupBy(*by).agg(window(0, lookback).alias("recent"), window(lookback, 2 * lookback).alias("earlier"), F.first("active_years").alias("active_years"))
    decay = F.when(F.col("earlier") > 0, 1 - F.col("recent") / F.col("earlier")).otherwise(F.lit(0.0))
    return x.select(*by, F.least(F.greatest(decay, F.lit(0.0)), F.lit(1.0)).alias("decay"), "active_years")


def decay_survival(events: DataFrame, publications: DataFrame, mode: str, end_year: int | None = None, keep: float = 0.95, repeats: int = 50, seed: int = 42, lookback: int = 2, threshold: float = 0.3) -> DataFrame:
    """(concept, survival): share of replicates in which the decline and two active years remain.

    events: incident().  Mode 'paper' drops the events that have no paper (Q16).
    """
    item = F.col("edge_seq").cast("string") if mode == "edge" else F.col("paper")
    masks = _masks(repeats, lambda r: _drawn(seed, mode, r, F.concat_ws("|", "concept", item), keep))
    x = events if mode == "edge" else events.where("has_paper").select("concept", "year", "paper").distinct()
    x = x.select("concept", "year", "paper", *masks)
    d = _declines(_yearly(x, repeats), publications, end_year, lookback, ("concept", "replicate"))
    ok = d.where((F.col("decay") >= threshold) & (F.col("active_years") >= 2)).groupBy("concept").agg((F.count("*") / F.lit(float(repeats))).alias("s"))
    return events.select("concept").distinct().join(ok, "concept", "left").select("concept", F.coalesce("s", F.lit(0.0)).alias("survival"))


def decay_addition_survival(events: DataFrame, plausible: DataFrame, publications: DataFrame, end_year: int | None = None, probability: float = 0.5, repeats: int = 50, seed: int = 42, lookback: int = 2, threshold: float = 0.3) -> DataFrame:
    """(concept, survival) with each plausible event (concept, item, year, paper) added by chance to all observed ones."""
    drawn = lambda r: _drawn(seed, "add", r, F.concat_ws("|", "concept", F.col("item").cast("string")), probability)
    own = events.select("concept", "year", "paper", *_masks(repeats, None))
    more = plausible.select("concept", "year", F.coalesce("paper", F.concat(F.lit("plausible-"), F.col("item").cast("string"))).alias("paper"), *_masks(repeats, drawn))
    d = _declines(_yearly(own.unionByName(more), repeats), publications, end_year, lookback, ("concept", "replicate"))
    ok = d.where((F.col("decay") >= threshold) & (F.col("active_years") >= 2)).groupBy("concept").agg((F.count("*") / F.lit(float(repeats))).alias("s"))
    return events.select("concept").distinct().join(ok, "concept", "left").select("concept", F.coalesce("s", F.lit(0.0)).alias("survival"))


def aggregate(*modes: Column) -> Column:
    """The least of the modes that could be evaluated."""
    return F.least(*modes) if len(modes) > 1 else modes[0]
