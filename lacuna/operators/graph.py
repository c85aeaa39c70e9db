"""Triples to a temporal multigraph: validation, filters, entity index, simple views, centrality.

A graph is two DataFrames.  edges: edge_seq, u, v, relation, confidence,
source_paper, year, evidence, u_type, v_type; one row a relation event, parallel
edges kept, self-loops dropped.  nodes: node, label, type, occurrences, papers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.names import key_column, label_column
from lacuna.functions.text import strict_year
from lacuna.operators import between
from lacuna.plans.runtime import Scratch, ship

# The relation vocabulary, labels too generic for a graph node, and those never drawn.
RELATIONS = ("USES", "IMPROVES", "ADDRESSES", "EVALUATES_ON", "PRODUCES", "CONTRADICTS", "EXTENDS", "LACKS", "COMBINES", "APPLIED_TO")
BAD_ENTITIES = ("our method", "the model", "this paper", "our approach", "the proposed method", "this work", "our framework")

MAX_ROUNDS = 200
ONE_GRAPH = 10_000_000  # distinct edges that one task takes; at 7,153,419 an executor of two tasks was seen at 2.8 GB
TASKS_A_CORE = 6  # of betweenness, so that a lost one costs little


def plain_key(name: Column) -> Column:
    """White space collapsed, trimmed, lower case: a key that any SQL engine can form."""
    return F.lower(F.trim(F.regexp_replace(name, "[ \\t\\r\\n]+", " ")))


def valid_triples(triples: DataFrame) -> DataFrame:
    """Rows whose both ends have a name; a missing confidence becomes 0.5."""
    ok = triples.where("subject.name is not null and object.name is not null")
    return ok.withColumn("confidence", F.coalesce("confidence", F.lit(0.5)))


def from_rich(triples: DataFrame) -> DataFrame:
    """The other triple layout (plain text ends, paper_id, evidence_quote) in the compact one."""
    end = lambda c: F.struct(F.col(c).alias("name"), F.col(f"{c}_type").alias("type")).alias(c)
    return triples.select("seq", end("subject"), "relation", end("object"), "confidence", F.col("evidence_quote").alias("evidence"), F.col("paper_id").alias("source_paper_id"), F.col("year").cast("string").alias("source_year"))


def edges_from_triples(triples: DataFrame, key: Callable[[Column], Column] = key_column, min_confidence: float = 0.3, relations: tuple[str, ...] | None = RELATIONS, bad: tuple[str, ...] = BAD_ENTITIES) -> DataFrame:
    """The graph's edges (B5-B10): ends by key, self pairs and empty keys dropped, then the confidence, generic-name and vocabulary filters.

    Filters on plain columns come first, so they reach the scan and fewer names
    are normalised.  A null relation is outside every vocabulary; a null or
    empty paper id stays null; a year that is no whole number is null.
    """
    t = valid_triples(triples).where(F.col("confidence") >= min_confidence)
    if relations is not None:
        t = t.where(F.col("relation").isin(*relations))
    t = t.select(
        F.col("seq").alias("edge_seq"), key(F.col("subject.name")).alias("u"), key(F.col("object.name")).alias("v"), "relation", "confidence",
        F.nullif(F.col("source_paper_id"), F.lit("")).alias("source_paper"), strict_year(F.col("source_year")).alias("year"), "evidence",
        F.col("subject.type").alias("u_type"), F.col("object.type").alias("v_type"), F.col("subject.name").alias("u_name"), F.col("object.name").alias("v_name"),
    )
    t = t.where("u != '' and v != '' and u != v")
    return t.where(~F.lower("u").isin(*bad) & ~F.lower("v").isin(*bad))


def endpoints(edges: DataFrame) -> DataFrame:
    """Two rows an edge: node with its name and type there."""
    end = lambda c, role: F.struct(F.col(c).alias("node"), F.col(f"{c}_name").alias("name"), F.col(f"{c}_type").alias("type"), F.lit(role).alias("role"))
    return edges.select("edge_seq", "relation", "confidence", "source_paper", "year", F.explode(F.array(end("u", 0), end("v", 1))).alias("x")).select("*", "x.*").drop("x")


def entity_index(edges: DataFrame) -> DataFrame:
    """(node, label, type, occurrences, papers): first-seen name and type, occurrences in both roles, distinct papers."""
    first = F.struct("edge_seq", "role")
    label = label_column(F.col("name0"))
    return (
        endpoints(edges)
        .groupBy("node")
        .agg(F.min_by("name", first).alias("name0"), F.min_by("type", first).alias("type"), F.count("*").alias("occurrences"), F.count_distinct("source_paper").alias("papers"))
        .select("node", label.alias("label"), F.coalesce("type", F.lit("UNKNOWN")).alias("type"), "occurrences", "papers")
    )


def simple(edges: DataFrame) -> DataFrame:
    """Undirected simple view (a, b), a < b."""
    return edges.where("u != v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def directed(edges: DataFrame) -> DataFrame:
    """Directed simple view (u, v)."""
    return edges.select("u", "v").distinct()


def both_ways(pairs: DataFrame) -> DataFrame:
    """(node, other): each undirected edge from both ends."""
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).toDF("node", "other")


def numbered(pairs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, node), pairs of ids): numbers in the order of the names, written once so that they stay.

    A global sort ranges the names over partitions; a row's number is its
    partition's number and its place there, so nothing is counted in one place.
    """
    ordered = both_ways(pairs).select("node").distinct().orderBy("node")
    nodes = scratch.save(ordered.select(F.monotonically_increasing_id().alias("id"), "node"), "nodes")
    p = pairs.join(nodes.toDF("ia", "a"), "a").join(nodes.toDF("ib", "b"), "b")
    return nodes, scratch.save(p.select(F.col("ia").alias("a"), F.col("ib").alias("b")), "pairs")


def degrees(pairs: DataFrame) -> DataFrame:
    return both_ways(pairs).groupBy("node").agg(F.count("*").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(node, degree, centrality): in plus out degree of the directed simple view over n - 1 (D20); 1.0 for a single node."""
    ends = directed(edges).select(F.explode(F.array("u", "v")).alias("node"))
    deg = ends.groupBy("node").agg(F.count("*").alias("degree"))
    n = deg.agg(F.count("*").alias("n"))
    return deg.join(F.broadcast(n)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(1.0)).alias("centrality"))  # n: one row


def weak_components(pairs: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; nodes of (a, b) pairs only.

    Alternates linking larger neighbours to the smallest one and smaller ones to
    it, which ends in stars after about log n rounds.
    """
    scratch = Scratch(pairs.sparkSession, "weak")
    edges = scratch.save(pairs.select("a", "b").where("a != b").distinct(), "start")
    mark = None
    for turn in range(MAX_ROUNDS):
        both = both_ways(edges)
        low = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("low", "node").alias("low"))
        large = both.join(low, "node").where("other > node").select(F.col("low").alias("a"), F.col("other").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
        low = down.groupBy("node").agg(F.min("other").alias("low"))
        small = down.join(low, "node").select(F.col("low").alias("a"), F.explode(F.array("node", "other")).alias("b")).where("a != b").distinct()
        after = scratch.save(small, f"round{turn}")
        scratch.drop(edges)
        edges = after
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components are unsettled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select("a", "a").distinct().toDF("node", "component"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, simple directed edges, density, papers, first and last year."""
    n = endpoints(edges).agg(F.count_distinct("node").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges"), F.count_distinct("u", "v").alias("simple_edges"), F.count_distinct("source_paper").alias("papers"), F.min("year").alias("min_year"), F.max("year").alias("max_year"))
    return e.join(F.broadcast(n)).select("nodes", "edges", "simple_edges", "papers", "min_year", "max_year", F.expr("try_divide(cast(edges as double), nodes * (nodes - 1))").alias("density"))  # one row each


def betweenness(edges: DataFrame, max_depth: int = 100) -> DataFrame:
    """(node, betweenness): directed, exact, normalised by (n - 1)(n - 2).

    Breadth-first search from every node, then the dependencies level by level
    backwards: nodes times edges of work.  The graph goes packed to every task
    and blocks of searches run there in NumPy (between), so that only sums a node
    are written; beyond ONE_GRAPH edges a level of all searches is one join
    (_joined).  Shortest paths longer than max_depth are an error.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "between")
    named = scratch.save(directed(edges).where("u != v").toDF("a", "b"), "edges")
    nodes, out = numbered(named, scratch)
    scratch.drop(named)
    if out.count() > ONE_GRAPH:
        sums = _joined(nodes, out, max_depth, scratch)
    else:
        ship(spark)
        pieces = scratch.save(out.coalesce(1).mapInArrow(between.packed, "name string, kind string, part int, data binary").repartition("name", "part"), "graph")
        g = between.unpacked(pieces.toLocalIterator())
        blocks, packed = between.blocks(g), spark.sparkContext.broadcast(g)
        tasks = max(1, min(blocks, TASKS_A_CORE * spark.sparkContext.defaultParallelism))
        parts = scratch.save(spark.range(0, blocks, 1, tasks).mapInArrow(lambda batches: between.made(batches, packed.value, max_depth), "id bigint, delta double"), "parts")
        if g and max_depth < 1 or not parts.where("id is null").isEmpty():
            raise RuntimeError(f"shortest paths are longer than {max_depth} edges")
        packed.unpersist()
        sums = parts.groupBy("id").agg(F.sum("delta").alias("delta"))
    n = nodes.agg(F.count("*").alias("n"))
    value = F.coalesce("delta", F.lit(0.0)) / ((F.col("n") - 1) * (F.col("n") - 2))
    return nodes.join(sums, "id", "left").join(F.broadcast(n)).select("node", F.when(F.col("n") > 2, value).otherwise(F.lit(0.0)).alias("betweenness"))  # n: one row


def _joined(nodes: DataFrame, out: DataFrame, max_depth: int, scratch: Scratch) -> DataFrame:
    """(id, delta) of distinct edges (a, b) by joins; nothing is gathered in one place, and searches of all nodes are written level by level."""
    out = out.toDF("u", "v")
    seen = scratch.save(nodes.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "level0")
    levels, front = [seen], seen
    while True:
        step = front.select("s", F.col("v").alias("u"), "sigma").join(out, "u").groupBy("s", "v").agg(F.sum("sigma").alias("sigma"))
        front = scratch.save(step.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(len(levels)).alias("d"), "sigma"), f"level{len(levels)}")
        if front.isEmpty():
            break
        if len(levels) > max_depth:
            raise RuntimeError(f"shortest paths are longer than {max_depth} edges")
        levels.append(front)
        seen = seen.unionByName(front)
    total = nodes.select(F.col("id").alias("v"), F.lit(0.0).alias("delta"))
    below = None
    for k in range(len(levels) - 1, 0, -1):
        own = levels[k].select("s", "v", "sigma")
        own = own.join(below, ["s", "v"], "left").withColumn("delta", F.coalesce("delta", F.lit(0.0))) if below is not None else own.withColumn("delta", F.lit(0.0))
        own = scratch.save(own, f"delta{k}")
        total = total.unionByName(own.groupBy("v").agg(F.sum("delta").alias("delta")))
        up = levels[k - 1].select("s", F.col("v").alias("u"), F.col("sigma").alias("su"))
        below = own.join(out, "v").join(up, ["s", "u"]).groupBy("s", F.col("u").alias("v")).agg(F.sum(F.col("su") / F.col("sigma") * (1 + F.col("delta"))).alias("delta"))
    return total.groupBy(F.col("v").alias("id")).agg(F.sum("delta").alias("delta"))
