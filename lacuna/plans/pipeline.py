"""The whole chain as one call: graph, detectors, gate, ranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.identity import describe
from lacuna.functions.names import key_column
from lacuna.operators import candidates, corpus, detect, gate, graph, resolve, score
from lacuna.plans.runtime import Scratch
from lacuna.sources import files


@dataclass(frozen=True)
class Config:
    """What a run may vary; the defaults are those of the shipped configuration."""

    min_confidence: float = 0.3
    relations: tuple[str, ...] | None = graph.RELATIONS
    key: Callable[[Column], Column] = key_column
    merge_names: bool = True
    fuzzy_threshold: int = 85
    cosine_threshold: float = 0.85
    top_links: int = 50
    min_cluster_ratio: float = 0.05
    max_inter_ratio: float = 0.1
    decay_threshold: float = 0.3
    lookback: int = 2
    top_ranked: int = 30
    on_error: str = "raise"
    gate: gate.Settings = field(default_factory=gate.Settings)


def collect_corpus(found: DataFrame, max_papers: int = 1000, min_words: int = 100, known: DataFrame | None = None) -> DataFrame:
    """Search results to a corpus: ids once, new ones only, the quality filter, the most cited, merged with what was known."""
    new = corpus.keep_first(found, F.col("paperId"), F.col("seq"))
    if known is not None:
        new = corpus.new_rows(new, known, "paperId").select(*found.columns)
    best = corpus.by_citations(corpus.basic_filter(new, min_words), max_papers)
    return best if known is None else corpus.merge_corpora(known, best, "paperId", "seq")


def screen_corpus(papers: DataFrame, target: int = 150, threshold: float = 0.7) -> DataFrame:
    """Papers with a nested screening to the relevant ones, best first, at most ``target``."""
    flat = papers.withColumns({"relevant": F.col("screening.relevant"), "confidence": F.col("screening.confidence")})
    return corpus.by_relevance(corpus.relevant(flat, threshold), target).drop("relevant", "confidence")


def build_graph(triples: DataFrame, c: Config = Config(), vectors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), both written; no triples give an empty graph.

    vectors: (name, vec) of entity names, for merging by meaning after merging by spelling.
    """
    scratch = Scratch(triples.sparkSession, "graph")
    edges = scratch.save(graph.edges_from_triples(triples, c.key, c.min_confidence, c.relations), "edges")
    if c.merge_names:
        names = graph.endpoints(edges).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("occurrences"), F.min("edge_seq").alias("seq"))
        names = scratch.save(names, "names")
        merged = scratch.save(resolve.merge_names(names, c.fuzzy_threshold, vectors, c.cosine_threshold).select("name", "canonical"), "merges")
        edges = scratch.save(resolve.apply_names(edges, merged), "merged")
    nodes = graph.entity_index(edges).join(graph.degree_centrality(edges), "node", "left")
    return scratch.save(nodes, "nodes"), edges


def detect_all(edges: DataFrame, c: Config = Config()) -> DataFrame:
    """All candidates of the three families (I8).

    A failing detector fails the run; with on_error 'skip' its family is left out.
    """
    scratch = Scratch(edges.sparkSession, "detect")
    pairs = scratch.save(graph.simple(edges), "simple")

    def links() -> DataFrame:
        return candidates.table(detect.common_neighbor_links(pairs, c.top_links), None, None, None)

    def clusters() -> DataFrame:
        member = scratch.save(detect.communities(pairs), "members")
        return candidates.table(None, detect.orphan_clusters(pairs, member, c.min_cluster_ratio, c.max_inter_ratio), member, None)

    def decays() -> DataFrame:
        return candidates.table(None, None, None, detect.temporal_decay(edges, c.lookback, c.decay_threshold, c.gate.snapshot_date))

    out = None
    for part in (links, clusters, decays):
        try:
            got = scratch.save(part(), part.__name__)
        except Exception:
            if c.on_error != "skip":
                raise
            continue
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise RuntimeError("every detector failed")
    return out


def write_run(folder: str, nodes: DataFrame, edges: DataFrame, found: DataFrame, papers: DataFrame | None) -> None:
    """A run's inputs to the gate in one folder, to be judged again from there: graph, candidates and corpus."""
    files.write_graph(nodes, edges, f"{folder}/graph")
    found.write.mode("overwrite").parquet(f"{folder}/candidates")
    if papers is not None:
        papers.write.mode("overwrite").parquet(f"{folder}/corpus_filtered")


def frozen_decisions(spark: SparkSession, folder: str, settings: gate.Settings = gate.Settings()) -> DataFrame:
    """The gate over a run's stored graph, candidates and corpus (A21); what the detectors found is taken as it is."""
    _, edges = files.read_graph(spark, f"{folder}/graph")
    papers = files.resolve_corpus(spark, None, folder)
    docs = None if papers is None else gate.documents(papers)
    return gate.decide(candidates.facts(edges, spark.read.parquet(f"{folder}/candidates"), docs, settings, searched=True), settings)


def run(triples: DataFrame, papers: DataFrame | None, c: Config = Config()) -> dict[str, DataFrame]:
    """nodes, edges, candidates, decisions, eligible, review and ranked of a corpus; papers None means that there is no corpus."""
    scratch = Scratch(triples.sparkSession, "run")
    nodes, edges = build_graph(triples, c)
    found = detect_all(edges, c)
    docs = None if papers is None else gate.documents(papers)
    decisions = scratch.save(gate.decide(candidates.facts(edges, found, docs, c.gate, searched=True), c.gate), "decisions")
    passed = decisions.where("status != 'rejected'")
    x = passed.join(candidates.mean_centrality(passed, nodes.select("node", "centrality")), "candidate", "left")
    text = describe(F.col("family"), F.col("head"), F.col("tail"), F.col("paths"), F.size("members"), F.col("inter_edge_ratio"), F.col("members"), F.col("concept"), F.col("peak_year"), F.col("decay_rate"))
    ranked = score.rank_candidates(x, c.top_ranked, tie="candidate").withColumn("description", text)
    return {
        "nodes": nodes,
        "edges": edges,
        "candidates": found,
        "decisions": decisions,
        "eligible": decisions.where("status = 'automatically_eligible'"),
        "review": decisions.where("status = 'review_required'"),
        "ranked": ranked,
    }
