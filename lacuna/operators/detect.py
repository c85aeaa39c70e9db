"""The three families of structural signals: missing links, orphan clusters, temporal decay."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lacuna.functions.text import year_of_date
from lacuna.operators import graph
from lacuna.plans.runtime import Scratch, ship

ONE_TASK = 4_000_000  # weighted neighbour rows that one task holds with room to spare


def two_hop_pairs(pairs: DataFrame) -> DataFrame:
    """(head, tail, common_neighbors), head < tail: non-adjacent nodes with a neighbour in common.

    A self-join on the middle node; the adaptive skew join splits hubs.
    """
    return _two_hop_among(pairs, None)


def _two_hop_among(pairs: DataFrame, ends: DataFrame | None) -> DataFrame:
    """two_hop_pairs whose two ends are in (node)."""
    adj = graph.both_ways(pairs)
    to = adj if ends is None else adj.join(ends.toDF("other"), "other", "left_semi").select("node", "other")
    left, right = to.toDF("mid", "head"), to.toDF("mid", "tail")
    hops = left.join(right, "mid").where("head < tail").groupBy("head", "tail").agg(F.count("*").alias("common_neighbors"))
    return hops.join(pairs.toDF("head", "tail"), ["head", "tail"], "left_anti")


def _named(best: DataFrame, nodes: DataFrame, *order) -> DataFrame:
    """The few best rows with the nodes' names instead of their numbers."""
    few = F.broadcast(best)  # top_k rows
    x = nodes.toDF("head_id", "head").join(few, "head_id")
    x = nodes.toDF("tail_id", "tail").join(F.broadcast(x), "tail_id")  # top_k rows
    return x.select("head", F.lit("RELATED_TO").alias("relation"), "tail", "prediction_score", "common_neighbors").orderBy(*order)


def common_neighbor_links(pairs: DataFrame, top_k: int = 50) -> DataFrame:
    """The top_k pairs by 10 * common / sqrt(degree * degree), then count, head and tail, all descending.

    No pair scores above 10, and only twins (nodes with the same neighbours)
    reach it.  Where there are top_k pairs of twins they are the answer, and the
    two-hop join, which is quadratic in a hub's degree, is not made.  The join
    runs over numbers that have the names' order.
    """
    scratch = Scratch(pairs.sparkSession, "links")
    nodes, p = graph.numbered(pairs, scratch)
    x = scratch.save(_twins(p, top_k), "twins")
    if x.count() < top_k:
        deg = graph.degrees(p)
        x = two_hop_pairs(p).join(deg.toDF("head", "dh"), "head").join(deg.toDF("tail", "dt"), "tail")
    score = F.lit(10.0) * (F.col("common_neighbors") / F.sqrt((F.col("dh") * F.col("dt")).cast("double")))
    x = x.select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"), score.alias("prediction_score"), "common_neighbors")
    best = x.orderBy(F.desc("prediction_score"), F.desc("common_neighbors"), F.desc("head_id"), F.desc("tail_id")).limit(top_k)
    return _named(best, nodes, F.desc("prediction_score"), F.desc("common_neighbors"), F.desc("head"), F.desc("tail"))


def _twins(p: DataFrame, top_k: int) -> DataFrame:
    """(head, tail, common_neighbors, dh, dt) of the top_k pairs of nodes with the same neighbours, or fewer.

    Neighbourhoods are told apart by two sums of hashes, which add up before they
    are shuffled; the pairs that come out are counted exactly.  Of a group only
    its top_k + 1 last nodes can be in the answer.
    """
    adj = graph.both_ways(p)
    sums = [F.sum(F.xxhash64(F.lit(i), "other").cast("decimal(20,0)")).alias(f"s{i}") for i in (1, 2)]
    sig = adj.groupBy("node").agg(F.count("*").alias("degree"), *sums)
    last = Window.partitionBy("degree", "s1", "s2").orderBy(F.desc("node"))
    sig = sig.withColumn("n", F.row_number().over(last)).where(F.col("n") <= top_k + 1)
    key = ["degree", "s1", "s2"]
    x = sig.select(*key, F.col("node").alias("head")).join(sig.select(*key, F.col("node").alias("tail")), key).where("head < tail")
    x = x.select("head", "tail", "degree").orderBy(F.desc("degree"), F.desc("head"), F.desc("tail")).limit(top_k)
    few = F.broadcast(x)  # top_k rows
    near = adj.toDF("head", "mid").join(few, "head").join(adj.toDF("tail", "mid"), ["tail", "mid"])
    exact = near.groupBy("head", "tail", "degree").agg(F.count("*").alias("common_neighbors")).where("common_neighbors = degree")
    return exact.select("head", "tail", "common_neighbors", F.col("degree").alias("dh"), F.col("degree").alias("dt"))


def structural_missing_links(pairs: DataFrame, top_k: int = 50, probe: int = 256) -> DataFrame:
    """The top_k pairs by number of common neighbours, then head and tail ascending; the count is the score.

    A pair has no more neighbours in common than its smaller degree.  The top_k
    count among the ``probe`` nodes of the highest degrees is therefore a degree
    below which no node can be in the answer, and those nodes stay out of the
    join.
    """
    scratch = Scratch(pairs.sparkSession, "links")
    nodes, p = graph.numbered(pairs, scratch)
    deg = scratch.save(graph.degrees(p), "degrees")
    some = deg.orderBy(F.desc("degree"), "node").limit(probe).select("node")
    counts = _two_hop_among(p, some).orderBy(F.desc("common_neighbors")).limit(top_k).agg(F.count("*"), F.min("common_neighbors")).first()
    least = counts[1] if counts[0] == top_k else 1
    x = _two_hop_among(p, deg.where(F.col("degree") >= least).select("node"))
    x = x.select(F.col("head").alias("head_id"), F.col("tail").alias("tail_id"), F.col("common_neighbors").cast("double").alias("prediction_score"), "common_neighbors")
    best = x.orderBy(F.desc("common_neighbors"), "head_id", "tail_id").limit(top_k)
    return _named(best, nodes, F.desc("common_neighbors"), "head", "tail")


def embedding_candidates(edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(head, relation, tail): directed two-hop pairs times the relations, without observed (h, r, t) and directed edges.

    relations: (relation), a vocabulary of a few rows.
    """
    d = graph.directed(edges)
    near = d.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(d.select(F.col("v").alias("x"), F.col("u").alias("y"))).distinct()
    hops = near.toDF("head", "mid").join(near.toDF("mid", "tail"), "mid").where("head != tail").select("head", "tail").distinct()
    hops = hops.join(d.toDF("head", "tail"), ["head", "tail"], "left_anti")
    return hops.join(F.broadcast(relations.select("relation").distinct()))  # a vocabulary


def embedding_pairs(edges: DataFrame, top_k: int = 5000) -> DataFrame:
    """(head, tail): the top_k pairs of embedding_candidates by common neighbours, then head and tail.

    Each of the (top_k + 1) / 2 best unordered pairs is a candidate in both
    directions, so the least of their counts bounds the degrees of the ends.
    """
    scratch = Scratch(edges.sparkSession, "embedding-pairs")
    d = scratch.save(graph.directed(edges), "directed")
    pairs = scratch.save(graph.simple(edges), "simple")
    half = (top_k + 1) // 2
    least = structural_missing_links(pairs, half).agg(F.count("*").alias("n"), F.min("common_neighbors").alias("least")).first()
    to = adj = graph.both_ways(pairs)
    if least["n"] == half:
        ends = graph.degrees(pairs).where(F.col("degree") >= least["least"]).select(F.col("node").alias("other"))
        to = adj.join(ends, "other", "left_semi").select("node", "other")
    hops = to.toDF("mid", "head").join(to.toDF("mid", "tail"), "mid").where("head != tail").groupBy("head", "tail").agg(F.count("*").alias("common_neighbors"))
    hops = hops.join(d.select(F.col("u").alias("head"), F.col("v").alias("tail")), ["head", "tail"], "left_anti")
    return hops.orderBy(F.desc("common_neighbors"), "head", "tail").limit(top_k).select("head", "tail")


def translation_scores(candidates: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame, top_k: int | None = None) -> DataFrame:
    """candidates with prediction_score = -|h + r - t| of given vectors (I5), higher is better; top_k in a total order."""
    e, r = entity_vectors.toDF("node", "vec"), relation_vectors.toDF("relation", "rv")
    x = candidates.join(e.toDF("head", "hv"), "head").join(e.toDF("tail", "tv"), "tail").join(r, "relation")
    diff = F.zip_with(F.zip_with("hv", "rv", lambda a, b: a + b), F.col("tv"), lambda a, b: a - b)
    norm = F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, d: s + d.cast("double") * d.cast("double")))
    x = x.select("head", "relation", "tail", (-norm).alias("prediction_score"))
    return x.orderBy(F.desc("prediction_score"), "head", "relation", "tail").limit(top_k) if top_k else x


def communities(pairs: DataFrame, rounds: int = 6, levels: int = 64, seed: int = 42) -> DataFrame:
    """(node, community) by modularity, for the simple graph's nodes.

    Local moving runs for all nodes at once: each looks at the communities of
    its neighbours and joins the best one if modularity gains; in a round half
    of the nodes (by a hash of node and round) may move, so that neighbours do
    not swap places for ever.  After ``rounds`` rounds communities become nodes
    and the next level begins, with half as many rounds.  It ends when, at the
    last level, no node at all would gain by moving; ``levels`` levels without
    that are an error.  A community is named by its smallest node.  Fixed by
    ``seed``; not the partition of any other Louvain program.

    As soon as a level has at most ONE_TASK neighbour rows, the same rounds go on
    in one task (_settled), with the same result, instead of some joins a round.
    """
    scratch = Scratch(pairs.sparkSession, "communities")
    numbers, pairs = graph.numbered(pairs, scratch)
    w = scratch.save(graph.both_ways(pairs).select(F.col("node").alias("x"), F.col("other").alias("y"), F.lit(1.0).alias("w")), "weights")
    m2 = w.agg(F.sum("w")).first()[0]
    member = scratch.save(w.select(F.col("x").alias("node"), F.col("x").alias("c")).distinct(), "members")
    names = numbers.toDF("node", "name")
    if not m2:
        return numbers.select("node", F.col("node").alias("community")).limit(0)
    for level in range(levels):
        if w.count() <= ONE_TASK:
            ship(pairs.sparkSession)
            own = w.coalesce(1).mapInArrow(lambda batches, level=level: _settled(batches, level, levels, rounds, m2, seed), "x bigint, to bigint")
            member = scratch.save(member.join(own.withColumnRenamed("x", "c"), "c").select("node", F.col("to").alias("c")), "members")
            break
        k = w.groupBy("x").agg(F.sum("w").alias("k"))
        own = scratch.save(k.select("x", "k", F.col("x").alias("c")), "own")
        moved_any, turn, all_may = False, 0, False
        while turn < (rounds if level == 0 else (rounds + 1) // 2) or (all_may and not moved_any):
            own, moves = _moved(w, own, m2, None if all_may else seed, level * 1000 + turn, scratch)
            moved_any, turn = moved_any or moves > 0, turn + 1
            if moves == 0 and all_may:
                break
            all_may = moves == 0  # a round without a move: let all look once more
        if not moved_any:
            break
        first = own.groupBy("c").agg(F.min("x").alias("first"))
        own = scratch.save(own.join(first, "c").select("x", F.col("first").alias("c")), "named")
        before = member, w
        member = scratch.save(member.join(own.select(F.col("x").alias("c"), F.col("c").alias("to")), "c").select("node", F.col("to").alias("c")), "members")
        w = scratch.save(w.join(own.select("x", F.col("c").alias("cx")), "x").join(own.select(F.col("x").alias("y"), F.col("c").alias("cy")), "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")), "weights")
        for old in before:
            scratch.drop(old)
    else:
        raise RuntimeError(f"communities still move after {levels} levels")
    first = member.groupBy("c").agg(F.min("node").alias("first"))
    x = member.join(first, "c").select("node", "first").join(names, "node").select("name", "first")
    return x.join(names.toDF("first", "community"), "first").select(F.col("name").alias("node"), "community")


def _moved(w: DataFrame, own: DataFrame, m2: float, seed: int | None, turn: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(own after a round, number of moves) of (x, k, c); without a seed all nodes may move."""
    tot = own.groupBy("c").agg(F.sum("k").alias("tot"))
    near = w.where("x != y").join(own.select(F.col("x").alias("y"), "c"), "y").groupBy("x", "c").agg(F.sum("w").alias("into"))
    here = own.select("x", "k", F.col("c").alias("mine")).join(tot.withColumnRenamed("c", "mine").withColumnRenamed("tot", "mytot"), "mine")
    opts = near.join(tot, "c").join(here, "x")
    gain = F.col("into") - F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)) / m2
    best = opts.groupBy("x").agg(F.max(F.struct(gain.alias("gain"), F.when(F.col("c") == F.col("mine"), 1).otherwise(0).alias("stay"), F.col("c"))).alias("best"), F.max(F.when(F.col("c") == F.col("mine"), gain)).alias("stay_gain"))
    may = F.lit(True) if seed is None else F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "x"), F.lit(2)) == 0
    alone = -F.col("k") * (F.col("mytot") - F.col("k")) / m2
    better = F.coalesce((F.col("best.gain") > F.coalesce("stay_gain", alone) + 1e-9) & may, F.lit(False))
    x = here.join(best, "x", "left").select("x", "k", F.when(better, F.col("best.c")).otherwise(F.col("mine")).alias("c"), better.alias("moved"))
    count = Observation()
    after = scratch.save(x.observe(count, F.count_if("moved").alias("moves")), "own")
    scratch.drop(own)
    return after.drop("moved"), count.get["moves"]


def _settled(batches: Iterator[pa.RecordBatch], level: int, levels: int, rounds: int, m2: float, seed: int) -> Iterator[pa.RecordBatch]:
    """(x, to): the community of each node of (x, y, w) when nothing moves any more, by the rounds of communities from ``level`` on."""
    t = pa.Table.from_batches(batches)
    ids, at = np.unique(np.concatenate([t["x"].to_numpy(), t["y"].to_numpy()]), return_inverse=True)
    x, y, w = at[: t.num_rows], at[t.num_rows :], t["w"].to_numpy()
    to, names = np.arange(len(ids)), ids
    for step in range(level, levels):
        k = np.bincount(x, w, len(names))
        apart = x != y
        near = x[apart], y[apart], w[apart]
        c, moved_any, turn, all_may = np.arange(len(names)), False, 0, False
        while turn < (rounds if step == 0 else (rounds + 1) // 2) or (all_may and not moved_any):
            may = np.ones(len(names), bool) if all_may else _half(seed, step * 1000 + turn, names)
            c, moves = _moved_here(*near, c, k, m2, may)
            moved_any, turn = moved_any or moves > 0, turn + 1
            if moves == 0 and all_may:
                break
            all_may = moves == 0
        if not moved_any:
            break
        _, first, group = np.unique(c, return_index=True, return_inverse=True)  # nodes are in the order of their ids
        order = np.argsort(first)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        group, names = place[group], names[first[order]]
        to = group[to]
        key, back = np.unique(group[x] * len(names) + group[y], return_inverse=True)
        x, y, w = key // len(names), key % len(names), np.bincount(back, w, len(key))
    else:
        raise RuntimeError(f"communities still move after {levels} levels")
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names[to], pa.int64())], ["x", "to"])


def _moved_here(x: np.ndarray, y: np.ndarray, w: np.ndarray, c: np.ndarray, k: np.ndarray, m2: float, may: np.ndarray) -> tuple[np.ndarray, int]:
    """_moved for nodes numbered in the order of their ids; weights are whole numbers, so sums do not depend on their order."""
    if not len(x):
        return c, 0
    n = len(c)
    tot = np.bincount(c, k, n)
    key = x * n + c[y]
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    into, key = np.add.reduceat(w[order], start), key[start]
    node, other = key // n, key % n
    stay = other == c[node]
    gain = into - k[node] * (tot[other] - np.where(stay, k[node], 0.0)) / m2
    start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    who = node[start]
    most = np.maximum.reduceat(gain, start)
    each = np.repeat(most, np.diff(np.r_[start, len(node)]))
    best = np.maximum.reduceat(np.where(gain == each, stay * n + other, -1), start) % n
    here = -k[who] * (tot[c[who]] - k[who]) / m2
    held = np.maximum.reduceat(np.where(stay, gain, -np.inf), start)
    better = (most > np.where(np.isinf(held), here, held) + 1e-9) & may[who]
    after = c.copy()
    after[who[better]] = best[better]
    return after, int(better.sum())


def _half(seed: int, turn: int, ids: np.ndarray) -> np.ndarray:
    """pmod(xxhash64(seed, turn, id), 2) = 0, as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    u = lambda v: np.array(v, np.uint64)
    turned = lambda h, b: (h << u(b)) | (h >> u(64 - b))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> u(33))) * p2
        h = (h ^ (h >> u(29))) * p3
        return h ^ (h >> u(32))

    with np.errstate(over="ignore"):
        h = u([42])
        for i in (seed, turn):
            h = mixed(turned((h + p5 + u(4)) ^ (u(i & 0xFFFFFFFF) * p1), 23) * p2 + p3)
        h = (h + p5 + u(8)) ^ (turned(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1)
        return mixed(turned(h, 27) * p1 + p4) & u(1) == 0


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the modularity of (node, community) on the simple graph."""
    both = graph.both_ways(pairs).join(membership.toDF("node", "cx"), "node").join(membership.toDF("other", "cy"), "other")
    m2 = both.agg(F.count("*").alias("m2"))
    per = both.groupBy("cx").agg(F.count("*").alias("k"), F.count_if(F.col("cx") == F.col("cy")).alias("inside"))
    return per.join(F.broadcast(m2)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("k") / F.col("m2"), 2)).alias("modularity"))  # m2: one row


def cluster_stats(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """(community, size, size_ratio, intra_edges, inter_edges, inter_edge_ratio) of every community."""
    c = membership.toDF("node", "community")
    sizes = c.groupBy("community").agg(F.count("*").alias("size"))
    ends = pairs.join(c.toDF("a", "ca"), "a").join(c.toDF("b", "cb"), "b")
    at = ends.select(F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community"), (F.col("ca") == F.col("cb")).alias("inside"))
    cnt = at.groupBy("community").agg(F.count_if(F.col("inside")).alias("intra_edges"), F.count_if(~F.col("inside")).alias("inter_edges"))
    n = sizes.agg(F.sum("size").alias("n"))
    x = sizes.join(cnt, "community", "left").na.fill(0, ["intra_edges", "inter_edges"]).join(F.broadcast(n))  # n: one row
    ratio = F.col("inter_edges") / F.greatest(F.col("inter_edges") + F.col("intra_edges"), F.lit(1))
    return x.select("community", "size", (F.col("size") / F.col("n")).alias("size_ratio"), "intra_edges", "inter_edges", ratio.alias("inter_edge_ratio"))


def orphan_clusters(pairs: DataFrame, membership: DataFrame, min_ratio: float = 0.05, max_inter_ratio: float = 0.1, mode: str = "or", min_nodes: int = 5) -> DataFrame:
    """The communities that are small or (mode 'and': and) isolated, most isolated first (B15, B16, F7); none in a graph below min_nodes."""
    x = cluster_stats(pairs, membership)
    small, apart = F.col("size_ratio") < min_ratio, F.col("inter_edge_ratio") < max_inter_ratio
    x = x.where(small | apart if mode == "or" else small & apart)
    n = membership.agg(F.count("*").alias("n"))
    return x.join(F.broadcast(n)).where(F.col("n") >= min_nodes).drop("n").orderBy("inter_edge_ratio", "community")  # n: one row


def year_bounds(edges: DataFrame, snapshot_date: str | None = None, exclude_partial: bool = True) -> DataFrame:
    """One row: min_year, observed_max_year, max_year; the last year falls away when the snapshot lies in it."""
    snap = year_of_date(F.lit(snapshot_date or ""))
    last = F.when(F.lit(exclude_partial) & (snap == F.col("observed_max_year")), F.col("observed_max_year") - 1).otherwise(F.col("observed_max_year"))
    return edges.where("year is not null").agg(F.min("year").alias("min_year"), F.max("year").alias("observed_max_year")).withColumn("max_year", last)


def papers_per_year(edges: DataFrame) -> DataFrame:
    """(year, publications): distinct papers on edges."""
    return edges.where("year is not null and source_paper is not null").groupBy("year").agg(F.count_distinct("source_paper").alias("publications"))


def node_year_papers(edges: DataFrame) -> DataFrame:
    """(node, year, papers): distinct papers of a node's edges; edges without a paper count by their ends and year."""
    e = edges.where("year is not null").withColumn("paper", F.coalesce("source_paper", F.concat_ws("-", F.lit("event"), "u", "v", F.col("year").cast("string"))))
    return e.select(F.explode(F.array("u", "v")).alias("node"), "year", "paper").groupBy("node", "year").agg(F.count_distinct("paper").alias("papers"))


def temporal_decay(edges: DataFrame, lookback: int = 2, threshold: float | None = 0.3, snapshot_date: str | None = None, exclude_partial: bool = True, publications: DataFrame | None = None, min_total: int = 3) -> DataFrame:
    """(concept, decay_rate, peak_year, peak_activity, recent_activity, earlier_activity, total_activity, analysis_end_year).

    Rates are distinct papers over the year's publications (at least 1), averaged
    over the two adjacent lookback windows that end in the last full year; no
    baseline means no decay; the peak is the earliest year of the highest rate.
    threshold None keeps every concept with min_total papers.
    """
    b = year_bounds(edges, snapshot_date, exclude_partial)
    pubs = publications if publications is not None else papers_per_year(edges)
    act = node_year_papers(edges).join(F.broadcast(b)).where("year <= max_year")  # b: one row
    act = act.join(F.broadcast(pubs), "year", "left")  # one row a year
    act = act.withColumn("rate", F.col("papers") / F.greatest(F.coalesce("publications", F.lit(0)), F.lit(1)))
    ago = F.col("max_year") - F.col("year")
    window = lambda lo, hi: F.coalesce(F.sum(F.when((ago >= lo) & (ago < hi), F.col("rate"))), F.lit(0.0)) / max(lookback, 1)
    x = act.groupBy("node").agg(
        window(0, lookback).alias("recent_activity"), window(lookback, 2 * lookback).alias("earlier_activity"), F.sum("papers").alias("total_activity"),
        F.max_by("year", F.struct("rate", -F.col("year"))).alias("peak_year"), F.max_by("papers", F.struct("rate", -F.col("year"))).alias("peak_activity"), F.max("max_year").alias("analysis_end_year"),
    )
    x = x.where(F.col("total_activity") >= min_total)
    decay = F.when(F.col("earlier_activity") > 0, 1 - F.col("recent_activity") / F.col("earlier_activity")).otherwise(F.lit(0.0))
    x = x.withColumn("decay_rate", decay)
    if threshold is not None:
        x = x.where(F.col("decay_rate") >= threshold)
    return x.select(F.col("node").alias("concept"), "decay_rate", "peak_year", "peak_activity", "recent_activity", "earlier_activity", "total_activity", "analysis_end_year")


def by_decay(decays: DataFrame) -> DataFrame:
    """The steepest decline first, then by name (F8)."""
    return decays.orderBy(F.desc("decay_rate"), "concept")


def temporal_profiles(edges: DataFrame, snapshot_date: str | None = None) -> DataFrame:
    """(node, year, papers, rate) for every year of the range, zero-filled."""
    b = year_bounds(edges, snapshot_date)
    act = node_year_papers(edges)
    spine = act.select("node").distinct().join(F.broadcast(b)).select("node", F.explode(F.sequence("min_year", "max_year")).alias("year"))  # b: one row
    x = spine.join(act, ["node", "year"], "left").join(F.broadcast(papers_per_year(edges)), "year", "left")  # one row a year
    papers = F.coalesce("papers", F.lit(0))
    return x.select("node", "year", papers.alias("papers"), (papers / F.greatest(F.coalesce("publications", F.lit(0)), F.lit(1))).alias("rate"))
