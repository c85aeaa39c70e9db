"""The candidate table: all three families in one, ready for the gate and for scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.draws import uniform
from lacuna.functions.names import key_column
from lacuna.functions.text import specificity
from lacuna.operators import detect, gate, graph, paths, stability
from lacuna.plans.runtime import Scratch


def table(links: DataFrame | None, clusters: DataFrame | None, members: DataFrame | None, decays: DataFrame | None) -> DataFrame:
    """(candidate, family, head, tail, concept, community, members, entities, prediction_score, inter_edge_ratio, decay_rate, peak_year).

    links as of detect.common_neighbor_links, clusters of detect.orphan_clusters
    with members (node, community), decays of detect.temporal_decay; None leaves a
    family out.  A cluster is defined by its twelve first members.
    """
    parts = []
    if links is not None:
        parts.append(links.select(F.concat_ws(" | ", F.lit("missing_link"), "head", "tail").alias("candidate"), F.lit("missing_link").alias("family"), "head", "tail", F.array("head", "tail").alias("entities"), "prediction_score"))
    if clusters is not None:
        m = members.toDF("node", "community").join(clusters.select("community"), "community", "left_semi").groupBy("community").agg(F.sort_array(F.collect_list("node")).alias("members"))
        parts.append(clusters.join(m, "community").select(F.concat_ws(" | ", F.lit("orphan_cluster"), F.col("community").cast("string")).alias("candidate"), F.lit("orphan_cluster").alias("family"), F.col("community").cast("string").alias("community"), F.slice("members", 1, 12).alias("entities"), "members", "inter_edge_ratio"))
    if decays is not None:
        parts.append(decays.select(F.concat_ws(" | ", F.lit("temporal_decay"), "concept").alias("candidate"), F.lit("temporal_decay").alias("family"), "concept", F.array("concept").alias("entities"), "decay_rate", "peak_year"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for name, kind in (("head", "string"), ("tail", "string"), ("concept", "string"), ("community", "string"), ("members", "array<string>"), ("prediction_score", "double"), ("inter_edge_ratio", "double"), ("decay_rate", "double"), ("peak_year", "int")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def plausible_direct(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(head, tail, item): the search for direct evidence of a link candidate (an extension; Q33).

    An item is a relation event at the head whose evidence text names the tail.
    """
    e = edges.select("edge_seq", F.lower(F.coalesce("evidence", F.lit(""))).alias("evidence"), F.explode(F.array_distinct(F.array("u", "v"))).alias("node"))
    x = links.select("head", "tail").join(e.withColumnRenamed("node", "head"), "head").where(F.contains("evidence", "tail"))
    return x.select("head", "tail", F.col("edge_seq").alias("item")).distinct()


def relevant_plausible(candidates: DataFrame, plausible: DataFrame) -> DataFrame:
    """(candidate, item, paper, year): of supplied edges (candidate, item, head, tail, paper, year) those that can challenge their candidate."""
    p = plausible.select("candidate", "item", F.trim("head").alias("ph"), F.trim("tail").alias("pt"), "paper", "year").where("ph != '' and pt != '' and ph != pt")
    x = p.join(candidates.select("candidate", "family", "head", "tail", "concept", "members"), "candidate")
    link = ((F.col("ph") == F.col("head")) & (F.col("pt") == F.col("tail"))) | ((F.col("ph") == F.col("tail")) & (F.col("pt") == F.col("head")))
    border = F.array_contains("members", F.col("ph")) != F.array_contains("members", F.col("pt"))
    at = (F.col("concept") == F.col("ph")) | (F.col("concept") == F.col("pt"))
    ok = F.when(F.col("family") == "missing_link", link).when(F.col("family") == "orphan_cluster", border).otherwise(at)
    return x.where(F.coalesce(ok, F.lit(False))).select("candidate", "item", "paper", "year")


def facts(
    edges: DataFrame,
    candidates: DataFrame,
    docs: DataFrame | None,
    s: gate.Settings = gate.Settings(),
    searched: bool = False,
    plausible: DataFrame | None = None,
    aliases: DataFrame | None = None,
    publications: DataFrame | None = None,
    end_year: int | None = None,
) -> DataFrame:
    """candidates with everything that gate.decide needs.

    docs: (doc, year, text) of the corpus, or None if there is none.  plausible:
    (candidate, item, head, tail, paper, year), edges that a search supplied; a
    column search_performed in candidates says that it ran, for an empty result
    is only then an answer.  searched: without supplied edges, make the search of
    plausible_direct for link candidates here.  Where no search ran the addition
    mode stays null and a candidate can reach review at most.  aliases:
    (candidate, entity_no, label), other names for the coverage screen.
    publications: (year, publications), else papers per year of docs or edges.
    """
    scratch = Scratch(edges.sparkSession, "facts")
    if "search_performed" not in candidates.columns:
        candidates = candidates.withColumn("search_performed", F.lit(searched) & (F.col("family") == "missing_link"))
    pairs = scratch.save(graph.simple(edges), "simple")
    sources = scratch.save(paths.edge_papers(edges), "sources")
    links = candidates.where("family = 'missing_link'").select("candidate", "head", "tail")
    if plausible is not None:
        pool = relevant_plausible(candidates, plausible)
    elif searched:
        pool = plausible_direct(edges, links).join(links, ["head", "tail"]).select("candidate", F.col("item").cast("string").alias("item"), F.lit(None).cast("string").alias("paper"), F.lit(None).cast("int").alias("year"))
    else:
        pool = candidates.select("candidate", F.lit("").alias("item"), F.lit(None).cast("string").alias("paper"), F.lit(None).cast("int").alias("year")).limit(0)
    pool = scratch.save(pool, "pool")
    opts = {"repeats": s.repeats, "seed": s.seed}

    p = scratch.save(paths.independent_paths(edges, links, s.max_path_length, sources), "paths")
    of_paths = scratch.save(paths.path_papers(p, sources), "papers")
    counts = links.join(p.groupBy("head", "tail").agg(F.count("*").alias("paths")), ["head", "tail"], "left").join(of_paths.groupBy("head", "tail").agg(F.count_distinct("item").alias("papers")), ["head", "tail"], "left").na.fill(0, ["paths", "papers"])
    by_edge = stability.link_survival(paths.path_edges(p), "edge", s.edge_keep, min_paths=s.min_surviving_paths, **opts).withColumnRenamed("survival", "s_edge")
    by_paper = stability.link_survival(of_paths, "paper", s.paper_keep, min_paths=s.min_surviving_paths, **opts).withColumnRenamed("survival", "s_paper")
    added = pool.join(links, "candidate").select("head", "tail", "item")
    by_add = stability.link_addition_survival(counts.select("head", "tail", "paths"), added, s.add_probability, min_paths=s.min_surviving_paths, **opts).withColumnRenamed("survival", "s_add")
    known = pairs.select(F.col("a").alias("head"), F.col("b").alias("tail"), F.lit(True).alias("existing_edge"))
    known = known.unionByName(known.select(F.col("tail").alias("head"), F.col("head").alias("tail"), "existing_edge"))
    x = counts
    for other in (*(scratch.save(by, "link-survival") for by in (by_edge, by_paper, by_add)), known):
        x = x.join(other, ["head", "tail"], "left")
    gone = F.coalesce("existing_edge", F.lit(False))
    part = [x.select("candidate", "papers", "paths", *[F.when(gone, 0.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("s_edge", "s_paper", "s_add")], gone.alias("existing_edge"))]

    rest = [F.lit(0).alias("paths"), F.lit(False).alias("existing_edge")]
    survival = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("s_edge", "s_paper", "s_add")]
    groups = candidates.where("family = 'orphan_cluster'").select("community", "candidate", F.explode("members").alias("node"))
    if not groups.isEmpty():
        m = groups.select("node", "community")
        named = groups.select("community", "candidate").distinct()
        at = scratch.save(stability.cluster_edges(pairs, m), "at")
        per = named.join(gate.internal_papers(edges, m), "community", "left")
        for mode, keep, name in (("edge", s.edge_keep, "s_edge"), ("paper", s.paper_keep, "s_paper")):
            per = per.join(stability.cluster_survival(at, mode, keep, isolation=s.isolation, sources=sources, **opts).withColumnRenamed("survival", name), "community", "left")
        added = pool.join(named, "candidate").select("community", "item")
        per = per.join(stability.cluster_addition_survival(at, added, s.add_probability, isolation=s.isolation, **opts).withColumnRenamed("survival", "s_add"), "community", "left")
        part.append(per.select("candidate", F.coalesce("papers", F.lit(0)).alias("papers"), *survival, *rest))

    concepts = candidates.where("family = 'temporal_decay'").select("candidate", "concept")
    ev = scratch.save(stability.incident(edges, concepts), "events")
    if publications is None:
        publications = docs.where("year is not null").groupBy("year").agg(F.count("*").alias("publications")) if docs is not None else detect.papers_per_year(edges)
    pubs = scratch.save(publications, "publications")
    if end_year is None:
        end_year = pubs.agg(F.max("year")).first()[0]  # one row a year
        if end_year is not None and s.snapshot_date and int(s.snapshot_date[:4]) == end_year:
            end_year -= 1
    per = concepts.join(ev.where("has_paper").groupBy("concept").agg(F.count_distinct("paper").alias("papers")), "concept", "left")
    rule = {"lookback": s.lookback, "threshold": s.decay}
    for mode, keep, name in (("edge", s.edge_keep, "s_edge"), ("paper", s.paper_keep, "s_paper")):
        per = per.join(scratch.save(stability.decay_survival(ev, pubs, mode, end_year, keep, **rule, **opts).withColumnRenamed("survival", name), "decline-survival"), "concept", "left")
    added = pool.join(concepts, "candidate").select("concept", "item", "year", "paper")
    per = per.join(scratch.save(stability.decay_addition_survival(ev, added, pubs, end_year, s.add_probability, **rule, **opts).withColumnRenamed("survival", "s_add"), "decline-survival"), "concept", "left")
    part.append(per.select("candidate", F.coalesce("papers", F.lit(0)).alias("papers"), *survival, *rest))

    part = [scratch.save(p, "facts") for p in part]  # one by one: the driver's memory grows with the plan
    got = reduce(DataFrame.unionByName, part)
    pools = pool.select("candidate").distinct().withColumn("pooled", F.lit(True))
    f = candidates.join(got, "candidate", "left").join(pools, "candidate", "left")
    f = f.withColumn("addition_available", F.coalesce("pooled", "search_performed", F.lit(False))).drop("pooled")
    f = f.withColumn("s_add", F.when(F.col("addition_available"), F.col("s_add")))
    both = [key_column(F.try_element_at("entities", F.lit(i))) for i in (1, 2)]
    f = f.withColumn("specificity", specificity(F.col("entities"))).withColumn("stability", F.least("s_edge", "s_paper", "s_add"))
    f = f.withColumn("self_link", F.coalesce((F.col("family") == "missing_link") & (both[0] == both[1]) & (both[0] != ""), F.lit(False)))
    if docs is None:
        return f.withColumn("closure_hits", F.lit(None).cast("bigint"))
    about = candidates.select("candidate", "family", F.posexplode(F.slice("entities", 1, 6)).alias("entity_no", "label"), "peak_year")
    if aliases is not None:
        own = candidates.select("candidate", "family", "peak_year")
        about = about.unionByName(aliases.select("candidate", F.col("entity_no").cast("int").alias("entity_no"), "label").join(own, "candidate"))
    hits = scratch.save(gate.closure_hits(about, docs, s.coverage).groupBy("candidate").agg(F.count("*").alias("closure_hits")), "hits")
    return f.join(hits, "candidate", "left").na.fill(0, ["closure_hits"])


def mean_centrality(candidates: DataFrame, centrality: DataFrame) -> DataFrame:
    """(candidate, mean_centrality) over the nodes that define each candidate: both ends, all members, or the concept."""
    nodes = F.when(F.col("family") == "orphan_cluster", F.col("members")).otherwise(F.col("entities"))
    x = candidates.select("candidate", F.explode(nodes).alias("node")).join(centrality.select("node", "centrality"), "node", "left")
    return x.groupBy("candidate").agg(F.avg(F.coalesce("centrality", F.lit(0.0))).alias("mean_centrality"))


def draw_order(candidates: DataFrame, seed: int = 42) -> DataFrame:
    """candidates with a fixed pseudo-random number for blinded review."""
    return candidates.withColumn("draw", uniform(F.lit(seed), F.col("candidate")))
