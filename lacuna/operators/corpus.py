"""Corpus stages: collection filters, deduplication, screening, ranking, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import truthy, word_count

# The outcome of the sequential quality filter, in its order.
FILTER_REASONS = ("no_abstract", "short_abstract", "no_title", "no_year", "passed")


def filter_reason(min_words: int = 100) -> Column:
    """The first reason a paper fails, or 'passed' (B1)."""
    return (
        F.when(truthy(F.col("abstract")).isNull(), "no_abstract")
        .when(word_count(F.col("abstract")) < min_words, "short_abstract")
        .when(truthy(F.col("title")).isNull(), "no_title")
        .when(truthy(F.col("year")).isNull(), "no_year")
        .otherwise("passed")
    )


def basic_filter(papers: DataFrame, min_words: int = 100) -> DataFrame:
    return papers.where(filter_reason(min_words) == "passed")


def filter_counts(papers: DataFrame, min_words: int = 100) -> DataFrame:
    """(reason, papers): every paper under the first reason that applies."""
    return papers.select(filter_reason(min_words).alias("reason")).groupBy("reason").agg(F.count("*").alias("papers"))


def keep_first(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of every key; rows of a null or empty key fall away (G1).

    A pre-aggregated minimum, so a key with many rows meets as one row a task.
    """
    keyed = df.withColumn("_key", truthy(key)).where("_key is not null")
    row = F.struct(*[F.col(c) for c in df.columns])
    return keyed.groupBy("_key").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def merge_corpora(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old and new without repeated keys; rows of old win."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    return keep_first(both, F.col(key), F.col("_from"), F.col(order)).drop("_from")


def new_rows(batch: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows of batch whose key is not in known."""
    return batch.join(known.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def by_citations(papers: DataFrame, max_papers: int, tie: str = "seq") -> DataFrame:
    """The max_papers most cited, ties by ``tie`` (F1)."""
    return papers.orderBy(F.desc(F.coalesce("citationCount", F.lit(0))), tie).limit(max_papers)


def per_query_cap(results: DataFrame, query: str, max_papers: int, n_queries: int, tie: str = "seq") -> DataFrame:
    """At most max_papers // n_queries + 100 rows of each query (F2)."""
    w = Window.partitionBy(query).orderBy(tie)
    return results.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_papers // max(n_queries, 1) + 100).drop("_n")


def latest_screening(screenings: DataFrame, key: Column) -> DataFrame:
    """(paper_key, relevant, confidence, reason) of the latest decision on each paper."""
    s = screenings.withColumn("paper_key", key).where("paper_key is not null")
    last = F.max_by(F.struct("relevant", "confidence", "reason"), F.struct("screened_at", "seq"))
    return s.groupBy("paper_key").agg(last.alias("s")).select("paper_key", "s.*")


def relevant(screened: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Decided relevant with enough confidence; a null in either is not."""
    return screened.where(F.col("relevant") & (F.col("confidence") >= threshold))


def by_relevance(screened: DataFrame, target: int, tie: str = "seq") -> DataFrame:
    """The ``target`` best by confidence * (1 + sqrt(citations))."""
    score = F.col("confidence") * (1 + F.sqrt(F.coalesce("citationCount", F.lit(0)).cast("double")))
    return screened.withColumn("relevance", score).orderBy(F.desc("relevance"), tie).limit(target)


def corpus_summary(papers: DataFrame) -> DataFrame:
    """(year, papers, mean_citations, mean_abstract_words)."""
    return papers.groupBy("year").agg(F.count("*").alias("papers"), F.avg("citationCount").alias("mean_citations"), F.avg(word_count(F.col("abstract"))).alias("mean_abstract_words"))


def audit(papers: DataFrame, triples: DataFrame) -> DataFrame:
    """(measure, value): counts of the integrity audit.

    Ids as stored; a paper id held by several rows counts its last row's abstract
    (by seq) for the evidence test.
    """
    p = papers.select("seq", truthy(F.col("paperId")).alias("id"), truthy(F.col("abstract")).alias("abstract"), F.coalesce("title", F.lit("")).alias("title"), truthy(F.element_at("externalIds", F.lit("DOI"))).alias("doi"), truthy(F.element_at("externalIds", F.lit("CorpusId"))).alias("corpus_id"))
    t = triples.select(truthy(F.col("source_paper_id")).alias("id"), truthy(F.col("evidence")).alias("evidence"))
    own = p.agg(
        F.count("*").alias("papers"), F.count_distinct("id").alias("unique_paper_ids"), F.count("abstract").alias("papers_with_abstract"), F.count("doi").alias("papers_with_doi"),
        F.count("corpus_id").alias("papers_with_corpus_id"), (F.count("*") - F.count_distinct(F.lower("title"))).alias("duplicate_titles"),
    )
    tri = t.agg(F.count("*").alias("triples"), F.count("id").alias("triples_with_paper_id"), F.count_distinct("id").alias("unique_triple_paper_ids"), F.count("evidence").alias("triples_with_evidence"))
    abstracts = p.where("id is not null").groupBy("id").agg(F.max_by("abstract", "seq").alias("abstract"))
    j = t.join(abstracts.withColumn("known", F.lit(True)), "id", "left")
    match = j.agg(
        F.count_if(F.col("evidence").isNotNull() & F.contains(F.lower(F.coalesce("abstract", F.lit(""))), F.lower("evidence"))).alias("evidence_exact_substring_of_source_abstract"),
        F.count_distinct(F.when(F.col("known").isNull(), F.col("id"))).alias("triple_paper_ids_not_in_corpus"),
    )
    row = own.join(F.broadcast(tri)).join(F.broadcast(match))  # one row each
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("bigint").alias("value")) for c in row.columns])).alias("x")).select("x.*")


def search(papers: DataFrame, text: str | None, families: DataFrame | None = None, wanted: tuple[str, ...] = ()) -> DataFrame:
    """Papers whose title, authors, venue or id contain the text, of any wanted family.

    families: (paperId, families array), as source_paper_inversion gives them.
    """
    x = papers
    if text:
        hay = F.lower(F.concat_ws(" ", "title", F.array_join(F.transform("authors", lambda a: F.coalesce(a["name"], F.lit(""))), " "), "venue", "paperId"))
        x = x.where(F.contains(hay, F.lit(text.lower())))
    if families is not None and wanted:
        x = x.join(families, "paperId").where(F.arrays_overlap("families", F.array(*map(F.lit, wanted))))
    return x
