"""Bounded paths between given pairs, and evidence paths that share neither edge nor paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import graph
from lacuna.plans.runtime import Scratch


MAX_ROUNDS = 500


def edge_papers(edges: DataFrame) -> DataFrame:
    """(a, b, paper): the distinct papers on all relation events between two nodes, both directions, one row each."""
    return edges.where("source_paper is not null").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.col("source_paper").alias("paper")).distinct()


def _walks(starts: DataFrame, adj: DataFrame, steps: int) -> list[DataFrame]:
    """Simple walks of 0 to ``steps`` edges from (pair, start): (pair, at, nodes)."""
    walk = starts.select("pair", F.col("start").alias("at"), F.array("start").alias("nodes"))
    out = [walk]
    for _ in range(steps):
        walk = walk.join(adj.select(F.col("node").alias("at"), "other"), "at").where("not array_contains(nodes, other)")
        walk = walk.select("pair", F.col("other").alias("at"), F.concat("nodes", F.array("other")).alias("nodes"))
        out.append(walk)
    return out


def simple_paths(pairs: DataFrame, candidates: DataFrame, cutoff: int = 4) -> DataFrame:
    """(head, tail, nodes): all simple paths of at most ``cutoff`` edges between the candidates' ends.

    pairs: the simple view (a, b).  Walks grow from both ends and meet in the
    middle, so a path of four edges costs two joins from each end and walks never
    start anywhere but at a candidate.  Equal or unknown ends have no path.
    """
    adj = graph.both_ways(pairs)
    c = candidates.select("head", "tail").where("head != tail").distinct().select(F.struct("head", "tail").alias("pair"))
    left = _walks(c.select("pair", F.col("pair.head").alias("start")), adj, (cutoff + 1) // 2)
    right = _walks(c.select("pair", F.col("pair.tail").alias("start")), adj, cutoff // 2)
    out = None
    for n in range(1, cutoff + 1):
        i, j = (n + 1) // 2, n // 2
        x = left[i].join(right[j].select("pair", "at", F.col("nodes").alias("back")), ["pair", "at"])
        x = x.where(F.size(F.array_intersect("nodes", "back")) == 1)
        x = x.select("pair", F.concat("nodes", F.slice(F.reverse("back"), 2, F.greatest(F.size("back") - 1, F.lit(1)))).alias("nodes") if j else F.col("nodes"))
        out = x if out is None else out.unionByName(x)
    return out.select("pair.head", "pair.tail", "nodes")


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair, nodes): walks from the head and walks from the tail that have their last node in common, and no other."""
    x = left.join(right.select("pair", "at", F.col("nodes").alias("back")), ["pair", "at"]).where(F.size(F.array_intersect("nodes", "back")) == 1)
    return x.select("pair", F.when(F.size("back") > 1, F.concat("nodes", F.slice(F.reverse("back"), 2, F.greatest(F.size("back") - 1, F.lit(1))))).otherwise(F.col("nodes")).alias("nodes"))


def shortest_paths(pairs: DataFrame, candidates: DataFrame, cutoff: int = 4, max_paths: int = 3) -> DataFrame:
    """(head, tail, path_no, nodes): up to ``max_paths`` simple paths, shortest first, then by their nodes (C11).

    Length by length; a pair that has its paths is not followed any farther.
    """
    scratch = Scratch(pairs.sparkSession, "shortest")
    adj, found = graph.both_ways(pairs), None
    open_ = scratch.save(candidates.select("head", "tail").where("head != tail").distinct().select(F.struct("head", "tail").alias("pair")), "open")
    for n in range(1, cutoff + 1):
        if open_.isEmpty():
            break
        left = _walks(open_.select("pair", F.col("pair.head").alias("start")), adj, (n + 1) // 2)[-1]
        right = _walks(open_.select("pair", F.col("pair.tail").alias("start")), adj, n // 2)[-1]
        now = _meet(left, right)
        now = now.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy("nodes"))).where(F.col("place") <= max_paths).drop("place")
        now = scratch.save(now, f"length{n}")
        found = now if found is None else found.unionByName(now)
        full = found.groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= max_paths).select("pair")
        open_ = scratch.save(open_.join(full, "pair", "left_anti"), "open")
    if found is None:
        found = open_.select("pair", F.array("pair.head").alias("nodes")).limit(0)
    w = Window.partitionBy("head", "tail").orderBy(F.size("nodes"), "nodes")
    return found.select("pair.head", "pair.tail", "nodes").withColumn("path_no", F.row_number().over(w)).where(F.col("path_no") <= max_paths)


def _hops(nodes: Column) -> Column:
    """The edges (a, b) along an array of nodes."""
    ends = lambda f, i: f(F.element_at(nodes, i), F.element_at(nodes, i + 1))
    return F.transform(F.sequence(F.lit(1), F.size(nodes) - 1), lambda i: F.struct(ends(F.least, i).alias("a"), ends(F.greatest, i).alias("b")))


def path_edges(paths: DataFrame) -> DataFrame:
    """(head, tail, path_no, item): an edge a row, as 'a~b'."""
    return paths.select("head", "tail", "path_no", F.explode(_hops(F.col("nodes"))).alias("e")).select("head", "tail", "path_no", F.concat_ws("~", "e.a", "e.b").alias("item"))


def path_papers(paths: DataFrame, sources: DataFrame) -> DataFrame:
    """(head, tail, path_no, item): a paper on the path's edges a row; sources as of edge_papers."""
    x = paths.select("head", "tail", "path_no", F.explode(_hops(F.col("nodes"))).alias("e")).select("head", "tail", "path_no", "e.a", "e.b")
    return x.join(sources, ["a", "b"]).select("head", "tail", "path_no", F.col("paper").alias("item")).distinct()


def independent_paths(edges: DataFrame, candidates: DataFrame, cutoff: int = 4, sources: DataFrame | None = None) -> DataFrame:
    """(head, tail, path_no, nodes): evidence paths that are edge- and paper-disjoint.

    As if taken greedily, shortest first, then by their nodes; only paths with a
    paper on every edge count (Q14), so walks go over such edges only.  Length by
    length: a path begins and ends with an edge at the pair's ends, and once such
    an edge or one of its papers is used no longer path can have it.  Longer
    walks therefore start from the edges that are still free, which are few
    where short paths were found, however many longer ones there are.
    """
    scratch = Scratch(edges.sparkSession, "independent")
    sources = scratch.save(edge_papers(edges), "sources") if sources is None else sources
    adj = graph.both_ways(scratch.save(sources.select("a", "b").where("a != b").distinct(), "pairs"))
    c = scratch.save(candidates.select("head", "tail").where("head != tail").distinct().select(F.struct("head", "tail").alias("pair")), "candidates")
    ends = c.select("pair", F.explode(F.array("pair.head", "pair.tail")).alias("node"))
    free = scratch.save(ends.join(adj, "node").select("pair", F.col("node").alias("end"), F.col("other").alias("at")), "free")
    taken = used = None
    for n in range(1, cutoff + 1):
        begin = lambda end: free.where(F.col("end") == F.col(f"pair.{end}")).select("pair", "at", F.array("end", "at").alias("nodes"))  # noqa: E731, B023
        left = _on(begin("head"), adj, (n + 1) // 2 - 1)
        right = _on(begin("tail"), adj, n // 2 - 1) if n > 1 else c.select("pair", F.col("pair.tail").alias("at"), F.array("pair.tail").alias("nodes"))
        now, more = _greedy(_meet(left, right), sources, used, scratch)
        if now is None:
            continue
        taken = now if taken is None else taken.unionByName(now)
        used = more if used is None else scratch.save(used.unionByName(more), "used")
        if n == cutoff:
            break
        at = free.select("*", F.least("end", "at").alias("a"), F.greatest("end", "at").alias("b"))
        held = _items(at, sources, "pair", "end", "at").join(used, ["pair", "item"], "left_semi").select("pair", "end", "at").distinct()
        free = scratch.save(free.join(held, ["pair", "end", "at"], "left_anti"), "free")
        if free.isEmpty():
            break
    if taken is None:
        taken = c.select("pair", F.array("pair.head").alias("nodes")).limit(0)
    by = Window.partitionBy("head", "tail").orderBy(F.size("nodes"), "nodes")  # disjoint paths: no more than the smaller end has neighbours
    out = taken.select("pair.head", "pair.tail", "nodes").withColumn("path_no", F.row_number().over(by)).select("head", "tail", "path_no", "nodes")
    out = Scratch(edges.sparkSession, "independent").save(out, "paths")
    scratch.clear()  # walks that nothing reads again
    return out


def _on(walk: DataFrame, adj: DataFrame, steps: int) -> DataFrame:
    """walk (pair, at, nodes) carried on by so many edges."""
    for _ in range(steps):
        walk = walk.join(adj.select(F.col("node").alias("at"), "other"), "at").where("not array_contains(nodes, other)")
        walk = walk.select("pair", F.col("other").alias("at"), F.concat("nodes", F.array("other")).alias("nodes"))
    return walk


def _items(hops: DataFrame, sources: DataFrame, *key: str) -> DataFrame:
    """(key, item): the edges of hops (key, a, b) and their papers."""
    edge = hops.select(*key, F.concat_ws("~", F.lit("edge"), "a", "b").alias("item"))
    return edge.unionByName(hops.join(sources, ["a", "b"]).select(*key, F.concat_ws("~", F.lit("paper"), "paper").alias("item")).distinct())


def _greedy(found: DataFrame, sources: DataFrame, used: DataFrame | None, scratch: Scratch) -> tuple[DataFrame | None, DataFrame | None]:
    """Of paths (pair, nodes) of one length those that the greedy order takes, and what (pair, item) they hold; None where there is none.

    used: what is held already.  Paths are rows: in a round every path is taken
    that is the first of all that are left to hold each of its edges and papers,
    and what shares one with a path taken falls away.
    """
    # A global sort, then a row's partition and place in it: numbers in the greedy order, written once.
    found = scratch.save(found.orderBy("pair", "nodes").withColumn("no", F.monotonically_increasing_id()), "found")
    if found.isEmpty():
        return None, None
    hops = found.select("no", "pair", F.explode(_hops(F.col("nodes"))).alias("e")).select("no", "pair", "e.a", "e.b")
    key = ["pair", "item"]
    items = _items(hops, sources, "no", "pair")
    if used is not None:  # edges first, which are few; papers only of what is left
        held = _items(hops.select("pair", "a", "b").distinct(), sources, "pair", "a", "b").join(used, key, "left_semi").select("pair", "a", "b").distinct()
        gone = hops.join(held, ["pair", "a", "b"], "left_semi").select("no").distinct()
        hops = scratch.save(hops.join(gone, "no", "left_anti"), "hops")
        items = _items(hops, sources, "no", "pair")
    items = scratch.save(items, "items")
    taken, holds = None, None
    for turn in range(MAX_ROUNDS):
        if items.isEmpty():
            break
        first = items.groupBy(*key).agg(F.min("no").alias("first"))
        now = scratch.save(items.join(first, key).groupBy("no").agg(F.every(F.col("no") == F.col("first")).alias("ok")).where("ok").select("no"), f"taken{turn}")
        own = scratch.save(items.join(now, "no", "left_semi").select(*key).distinct(), f"used{turn}")
        gone = items.join(own, key, "left_semi").select("no").distinct()
        left = scratch.save(items.join(gone, "no", "left_anti"), f"items{turn}")
        scratch.drop(items)
        items, taken, holds = left, now if taken is None else taken.unionByName(now), own if holds is None else holds.unionByName(own)
    else:
        raise RuntimeError(f"paths are undecided after {MAX_ROUNDS} rounds")
    return (None, None) if taken is None else (scratch.save(found.join(taken, "no", "left_semi").select("pair", "nodes"), "chosen"), scratch.save(holds, "holds"))


def evidence(edges: DataFrame, candidates: DataFrame, cutoff: int = 4, max_paths: int = 3) -> DataFrame:
    """(head, tail, path_no, nodes): up to ``max_paths`` independent evidence paths of each pair; where it has none, its shortest paths."""
    scratch = Scratch(edges.sparkSession, "evidence")
    own = scratch.save(independent_paths(edges, candidates, cutoff).where(F.col("path_no") <= max_paths), "independent")
    rest = candidates.select("head", "tail").distinct().join(own.select("head", "tail").distinct(), ["head", "tail"], "left_anti")
    return own.unionByName(shortest_paths(graph.simple(edges), rest, cutoff, max_paths).select(*own.columns))
