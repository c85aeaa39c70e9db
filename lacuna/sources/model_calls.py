"""Model calls per row: screening, extraction and baselines.

A client is any function from a prompt to a text.  It is made once per task by a
factory, called with bounded retries, and never called for rows that an earlier
run has answered.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.text import chunk_words, extract_field
from lacuna.operators import retrieval
from lacuna.plans.runtime import ship


class QuotaExceeded(RuntimeError):
    """No more calls are allowed; retrying is useless."""


def fill(template: str, **values: Column) -> Column:
    """The template with each {name} replaced."""
    out = F.lit(template)
    for name, col in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(col.cast("string"), F.lit("")))
    return out


def answers(df: DataFrame, key: str, prompt: str, factory: Callable[[], Callable[[str], str]], retries: int = 3, wait: float = 1.0, done: DataFrame | None = None) -> DataFrame:
    """(key, answer, error): the client's answer to every prompt; null with the error after ``retries`` failures.

    done: keys answered before, which are not asked again (C8).  QuotaExceeded ends
    the job, so that no empty answers are written for rows that were never asked.
    """
    ship(df.sparkSession)
    todo = df.select(F.col(key).alias("key"), F.col(prompt).alias("prompt")).where("prompt is not null")
    if done is not None:
        todo = todo.join(done.select(F.col(key).alias("key")).distinct(), "key", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for frame in frames:
            rows = []
            for k, p in zip(frame["key"], frame["prompt"], strict=True):
                answer, error = None, None
                for attempt in range(retries):
                    try:
                        answer, error = ask(p), None
                        break
                    except QuotaExceeded:
                        raise
                    except Exception as e:  # the client's own kinds of error
                        error = f"{type(e).__name__}: {e}"
                        if attempt + 1 < retries:
                            time.sleep(wait * 2**attempt)
                rows.append((k, answer, error))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    kind = df.schema[key].dataType.simpleString()
    return todo.mapInPandas(run, f"key {kind}, answer string, error string").withColumnRenamed("key", key)


def _fenced(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")


def parse_screening(answer: Column) -> Column:
    """struct(relevant, confidence, reason) of a JSON answer, with defaults for what is missing."""
    j = F.from_json(_fenced(answer), "relevant string, confidence string, reason string")
    return F.struct(F.coalesce(F.lower(j.relevant).isin("true", "1", "yes"), F.lit(False)).alias("relevant"), F.coalesce(j.confidence.try_cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce(j.reason, F.lit("")).alias("reason"))


TRIPLES = "array<struct<subject:struct<name:string,type:string>,relation:string,object:struct<name:string,type:string>,confidence:double,evidence:string>>"


def parse_triples(answer: Column) -> Column:
    """The well-formed triples of a JSON answer: names stripped, both there, confidence 0.5 where missing."""
    raw = F.coalesce(F.from_json(_fenced(answer), f"triples {TRIPLES}")["triples"], F.from_json(_fenced(answer), TRIPLES), F.array().cast(TRIPLES))
    end = lambda e: F.struct(F.trim(e["name"]).alias("name"), F.coalesce(e["type"], F.lit("UNKNOWN")).alias("type"))
    ok = F.filter(raw, lambda t: t.subject["name"].isNotNull() & t["object"]["name"].isNotNull() & t.relation.isNotNull())
    return F.transform(ok, lambda t: F.struct(end(t.subject).alias("subject"), t.relation.alias("relation"), end(t["object"]).alias("object"), F.coalesce(t.confidence, F.lit(0.5)).alias("confidence"), t.evidence.alias("evidence")))


def extract_triples(papers: DataFrame, template: str, factory: Callable, size: int = 1500, overlap: int = 200, done: DataFrame | None = None, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(paperId, chunk_no, subject, relation, object, confidence, evidence, source_paper_id, source_year) from every chunk of every paper."""
    todo = papers if done is None else papers.join(done.select("paperId").distinct(), "paperId", "left_anti")
    chunks = todo.select("paperId", "year", "title", F.posexplode(chunk_words(F.concat_ws(" ", "title", "abstract"), size, overlap)).alias("chunk_no", "chunk"))
    asked = chunks.withColumn("ref", F.struct("paperId", "chunk_no")).withColumn("prompt", fill(template, title=F.col("title"), text=F.col("chunk")))
    asked = asked.withColumn("ref", F.to_json("ref"))
    got = answers(asked, "ref", "prompt", factory, retries, wait).where("answer is not null")
    x = got.join(asked.select("ref", "paperId", "chunk_no", "year"), "ref").select("paperId", "chunk_no", "year", F.explode(parse_triples(F.col("answer"))).alias("t"))
    return x.select("paperId", "chunk_no", "t.*", F.col("paperId").alias("source_paper_id"), F.col("year").cast("string").alias("source_year"))


def screen(papers: DataFrame, template: str, factory: Callable, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """Papers with an abstract, with their screening."""
    p = papers.where("coalesce(abstract, '') != ''").withColumn("prompt", fill(template, title=F.col("title"), abstract=F.col("abstract")))
    got = answers(p, "paperId", "prompt", factory, retries, wait)
    return p.drop("prompt").join(got.select("paperId", parse_screening(F.col("answer")).alias("screening")), "paperId")


# The labels of a structured answer, and what is added to a topic where no model answers.
GAP_FIELDS = ("RESEARCH_GAPS", "RESEARCH_DIRECTION", "SOLUTION_APPROACH", "REMAINING_GAPS")
QUERY_WORDS = ("survey", "framework", "deep learning", "methods")


def parse_fields(answer: Column, fields: tuple[str, ...] = GAP_FIELDS) -> list[Column]:
    """One column a labelled field of an answer."""
    return [extract_field(answer, f, fields).alias(f.lower()) for f in fields]


def parse_gap_list(answer: Column, most: int = 3) -> Column:
    """The gaps of a JSON answer, else its first non-blank lines."""
    listed = F.coalesce(F.from_json(_fenced(answer), "gaps array<string>")["gaps"], F.from_json(_fenced(answer), "array<string>"))
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.slice(F.coalesce(listed, lines), 1, most)


def retrieval_baseline(papers: DataFrame, template: str, factory: Callable, queries: DataFrame | None = None, k: int = 3, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(paperId, neighbours, research_gaps, ...): one answer a paper over the abstracts of its k nearest papers.

    papers: (paperId, title, abstract).  queries: (paperId) of the papers to
    answer for, all by default.  A paper without a neighbour gets an empty
    context.
    """
    docs = papers.where("coalesce(abstract, '') != ''").select(F.col("paperId").alias("doc"), F.concat_ws(" ", "title", "abstract").alias("text"))
    ask = (docs.select(F.col("doc").alias("query")) if queries is None else queries.select(F.col("paperId").alias("query"))).distinct()
    near = retrieval.top_similar(retrieval.tfidf(docs), ask, k).join(docs, "doc")
    context = near.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc", "text"))), lambda x: x.text).alias("texts"), F.sort_array(F.collect_list("doc")).alias("neighbours"))  # k rows
    x = ask.join(docs.toDF("query", "own"), "query").join(context, "query", "left")
    x = x.select(F.col("query").alias("paperId"), F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours"), fill(template, text=F.col("own"), context=F.array_join(F.coalesce("texts", F.array().cast("array<string>")), "\n\n")).alias("prompt"))
    got = answers(x, "paperId", "prompt", factory, retries, wait)
    return x.select("paperId", "neighbours").join(got.select("paperId", *parse_fields(F.col("answer"))), "paperId")


def abstract_baseline(papers: DataFrame, template: str, factory: Callable, characters: int = 800, most: int = 3, retries: int = 3, wait: float = 1.0) -> DataFrame:
    """(paperId, position, text): up to ``most`` gaps a paper from the beginning of its abstract, which is what this baseline shows a model."""
    p = papers.where("coalesce(abstract, '') != ''").select("paperId", fill(template, title=F.col("title"), abstract=F.substring("abstract", 1, characters)).alias("prompt"))
    got = answers(p, "paperId", "prompt", factory, retries, wait).where("answer is not null")
    return got.select("paperId", F.posexplode(parse_gap_list(F.col("answer"), most)).alias("position", "text"))


def expand_query(topic: str, answer: str | None = None) -> list[str]:
    """Five search queries for a topic: those of a JSON answer if it holds exactly five, else plain templates."""
    try:
        found = json.loads(answer or "null")
        listed = [q.strip() for q in found["queries"] if isinstance(q, str) and q.strip()]
        if len(listed) == 1 + len(QUERY_WORDS):
            return listed
    except (ValueError, TypeError, KeyError):
        pass
    return [topic, *(f"{topic} {w}" for w in QUERY_WORDS)]
