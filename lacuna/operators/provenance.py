"""From candidates to papers and edge-level evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import truthy


def _record(extra: str) -> list:
    return [F.col(extra), F.col("u").alias("subject"), F.coalesce("relation", F.lit("RELATED_TO")).alias("relation"), F.col("v").alias("object"), F.col("source_paper").alias("paper_id"), F.col("year"), F.coalesce("evidence", F.lit("")).alias("evidence")]


def _once(records: DataFrame) -> DataFrame:
    return records.dropDuplicates(["candidate", "subject", "relation", "object", "paper_id", "evidence"])


def path_records(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Relation events, both directions, on the hops of (candidate, nodes) paths."""
    hop = F.transform(F.sequence(F.lit(1), F.size("nodes") - 1), lambda i: F.struct(F.least(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("a"), F.greatest(F.element_at("nodes", i), F.element_at("nodes", i + 1)).alias("b")))
    hops = paths.where(F.size("nodes") > 1).select("candidate", F.explode(hop).alias("h")).select("candidate", "h.a", "h.b").distinct()
    e = edges.withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v")}).join(hops, ["a", "b"])
    return _once(e.select(*_record("candidate")))


def cluster_records(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Relation events with both ends in a candidate's (candidate, node) members."""
    e = edges.join(members.toDF("candidate", "u"), "u").join(members.toDF("cv", "v"), "v").where("candidate = cv")
    return _once(e.select(*_record("candidate")))


def concept_records(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Relation events at a candidate's (candidate, concept)."""
    at = concepts.toDF("candidate", "node")
    e = edges.withColumn("node", F.explode(F.array_distinct(F.array("u", "v")))).join(at, "node")
    return _once(e.select(*_record("candidate")))


def paper_cards(papers: DataFrame) -> DataFrame:
    """One card a paper id, the first by seq."""
    first = papers.where(truthy(F.col("paperId")).isNotNull()).groupBy("paperId").agg(F.min_by(F.struct("title", "authors", "year", "venue", "citationCount", "url", "externalIds"), "seq").alias("p"))
    return first.select(
        F.col("paperId").alias("paper_id"), truthy(F.col("p.title")).alias("title"), F.filter(F.transform("p.authors", lambda a: a["name"]), lambda n: n.isNotNull() & (n != "")).alias("authors"), F.col("p.year").alias("paper_year"),
        F.coalesce("p.venue", F.lit("")).alias("venue"), F.coalesce("p.citationCount", F.lit(0)).alias("citation_count"), F.coalesce("p.url", F.lit("")).alias("url"), F.coalesce(F.element_at("p.externalIds", F.lit("DOI")), F.lit("")).alias("doi"),
    )


def resolve(records: DataFrame, papers: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """(candidate, paper_id, title, paper_year, venue, evidence_records) of every supporting paper.

    explicit: (candidate, paper_id) ids to list besides those of the records.  A
    paper without a card is titled 'Paper <id>'.
    """
    r = records.where("paper_id is not null").groupBy("candidate", "paper_id").agg(F.count("*").alias("evidence_records"))
    if explicit is not None:
        r = r.unionByName(explicit.where("paper_id is not null").select("candidate", "paper_id", F.lit(0).cast("bigint").alias("evidence_records"))).groupBy("candidate", "paper_id").agg(F.sum("evidence_records").alias("evidence_records"))
    x = r.join(paper_cards(papers).select("paper_id", "title", "paper_year", "venue"), "paper_id", "left")
    return x.select("candidate", "paper_id", F.coalesce("title", F.concat(F.lit("Paper "), "paper_id")).alias("title"), "paper_year", F.coalesce("venue", F.lit("")).alias("venue"), "evidence_records")


def inversion(resolved: DataFrame, families: DataFrame) -> DataFrame:
    """(paper_id, candidates, families): the candidates each paper supports.

    families: (candidate, family).
    """
    x = resolved.join(families.select("candidate", "family"), "candidate")
    return x.groupBy("paper_id").agg(F.count_distinct("candidate").alias("candidates"), F.sort_array(F.collect_set("family")).alias("families"))


def listed(resolved: DataFrame) -> DataFrame:
    """resolve's rows in reading order: by candidate, newest papers first, then by title."""
    return resolved.orderBy("candidate", F.desc(F.coalesce("paper_year", F.lit(0))), F.lower("title"), "paper_id")


def by_support(inverted: DataFrame, papers: DataFrame) -> DataFrame:
    """inversion's rows with the papers of most candidates first, then the newest, then by title."""
    x = inverted.join(paper_cards(papers).select("paper_id", "title", "paper_year"), "paper_id", "left")
    return x.orderBy(F.desc("candidates"), F.desc(F.coalesce("paper_year", F.lit(0))), F.lower(F.coalesce("title", F.lit(""))), "paper_id").select(*inverted.columns)
