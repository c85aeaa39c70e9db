"""Corpus, evaluation and retrieval queries over whole tables, with their oracle SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.catalog import query
from lacuna.functions.draws import uniform
from lacuna.functions.ids import id_form
from lacuna.functions.text import STOPWORDS, chunk_words, strict_year, tokens, word_count
from lacuna.operators import corpus, evaluation, orphans, retrieval
from lacuna.plans.runtime import Scratch, table

_id = lambda c: f"nullif(lower(regexp_replace({c}, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')), '')"
_WS = "[ \\t\\r\\n\\f\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"
_clean = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"
_words = lambda c: f"CASE WHEN {c} IS NULL THEN 0 WHEN {_clean(c)} = '' THEN 0 ELSE len(string_split({_clean(c)}, ' ')) END"

_STATE = f"""WITH ev AS (
  SELECT {_id("paperId")} AS id, collected_at AS t, 0 AS turn, 1 AS here, NULL AS ref_table, NULL::BIGINT AS ref_seq FROM papers WHERE collected_at IS NOT NULL
  UNION ALL SELECT {_id("paperId")}, withdrawn_at, 1, 0, NULL, NULL FROM withdrawals WHERE withdrawn_at IS NOT NULL
  UNION ALL SELECT {_id("source_paper_id")}, extracted_at, 2, NULL, 'triples', seq FROM triples WHERE extracted_at IS NOT NULL
  UNION ALL SELECT {_id("paperId")}, screened_at, 2, NULL, 'screenings', seq FROM screenings WHERE screened_at IS NOT NULL),
st AS (SELECT *, last_value(here IGNORE NULLS) OVER (PARTITION BY id ORDER BY t, turn ROWS UNBOUNDED PRECEDING) AS now FROM ev WHERE id IS NOT NULL)"""


def _orphan_sources(spark: SparkSession, d: str) -> tuple:
    refs = {
        "triples": orphans.Source(table(spark, d, "triples"), "source_paper_id", "extracted_at", "seq"),
        "screenings": orphans.Source(table(spark, d, "screenings"), "paperId", "screened_at", "seq"),
    }
    return refs, orphans.Source(table(spark, d, "papers"), "paperId", "collected_at"), orphans.Source(table(spark, d, "withdrawals"), "paperId", "withdrawn_at")


def _ledger(spark: SparkSession, d: str, steps: int = 6) -> orphans.OrphanLedger:
    """The tables taken in year by year of their times (several years at once beyond ``steps`` years), each step from the state that the last one left."""
    refs, parents, gone = _orphan_sources(spark, d)
    years = [r[0] for r in parents.df.select(F.year(parents.time)).distinct().where(F.year(parents.time).isNotNull()).collect()]  # calendar years
    years = sorted(years)[1 :: max(1, -(-len(years) // steps))]
    ledger = orphans.OrphanLedger(spark, f"{Scratch(spark, 'ledger').root}/ledger")
    for low, high in zip([None, *years], [*years, None], strict=True):

        def within(s: orphans.Source, low: int | None = low, high: int | None = high) -> orphans.Source:
            t = F.col(s.time)
            begins = F.lit(True) if low is None else t >= F.make_timestamp_ntz(F.lit(low), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
            ends = F.lit(True) if high is None else t < F.make_timestamp_ntz(F.lit(high), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
            return replace(s, df=s.df.where(begins & ends))

        ledger.advance({name: within(s) for name, s in refs.items()}, within(parents), within(gone))
    return ledger


@query(f"{_STATE} SELECT ref_table, ref_seq FROM st WHERE turn = 2 AND coalesce(now, 0) = 0")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).orphans().select("ref_table", "ref_seq")


@query(
    f"""{_STATE},
months AS (SELECT id, year(t) * 12 + month(t) - 1 AS month, arg_max(here, (t, turn)) FILTER (WHERE here IS NOT NULL) AS last_here,
  count(*) FILTER (WHERE ref_table = 'triples') AS tr, count(*) FILTER (WHERE ref_table = 'screenings') AS sc FROM ev WHERE id IS NOT NULL GROUP BY 1, 2),
run AS (SELECT id, month, tr, sc, coalesce(last_value(last_here IGNORE NULLS) OVER w, 0) AS after, sum(tr) OVER w AS ctr, sum(sc) OVER w AS csc FROM months WINDOW w AS (PARTITION BY id ORDER BY month ROWS UNBOUNDED PRECEDING)),
lng AS (SELECT 'triples' AS ref_table, id, month, tr AS refs, CASE WHEN after = 1 THEN 0 ELSE ctr END AS waiting FROM run UNION ALL SELECT 'screenings', id, month, sc, CASE WHEN after = 1 THEN 0 ELSE csc END FROM run),
chg AS (SELECT *, waiting - coalesce(lag(waiting) OVER (PARTITION BY ref_table, id ORDER BY month), 0) AS change FROM lng),
per AS (SELECT ref_table, month, sum(change) AS change, sum(refs) AS refs FROM chg GROUP BY 1, 2 HAVING sum(refs) > 0 OR sum(change) <> 0),
orp AS (SELECT ref_table, year(t) * 12 + month(t) - 1 AS month, count(*) AS orphans FROM st WHERE turn = 2 AND coalesce(now, 0) = 0 GROUP BY 1, 2)
SELECT p.ref_table, printf('%04d-%02d', p.month // 12, p.month % 12 + 1) AS period, coalesce(orphans, 0) AS orphans, (sum(change) OVER (PARTITION BY p.ref_table ORDER BY p.month))::BIGINT AS open_at_end
FROM per p LEFT JOIN orp o ON o.ref_table = p.ref_table AND o.month = p.month"""
)
def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).counts()


@query(
    f"""SELECT CASE WHEN coalesce(abstract, '') IN ('', '0') THEN 'no_abstract' WHEN {_words("abstract")} < 100 THEN 'short_abstract'
  WHEN coalesce(title, '') IN ('', '0') THEN 'no_title' WHEN coalesce(year, 0) = 0 THEN 'no_year' ELSE 'passed' END AS reason, count(*) AS papers FROM papers GROUP BY 1"""
)
def basic_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.filter_counts(table(spark, d, "papers"))


@query("SELECT seq, paperId, title, year FROM papers WHERE coalesce(paperId, '') NOT IN ('', '0') QUALIFY row_number() OVER (PARTITION BY paperId ORDER BY seq) = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return corpus.keep_first(table(spark, d, "papers").select("seq", "paperId", "title", "year"), F.col("paperId"), F.col("seq"))


@query("SELECT seq, batch_no, paperId FROM papers p WHERE batch_no > 0 AND NOT EXISTS (SELECT 1 FROM papers o WHERE o.batch_no = 0 AND o.paperId = p.paperId)")
def incremental_antijoin(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select("seq", "batch_no", "paperId")
    return corpus.new_rows(p.where("batch_no > 0"), p.where("batch_no = 0"), "paperId").select("seq", "batch_no", "paperId")


@query(
    """WITH u AS (SELECT 0 AS f, seq, paperId, batch_no FROM papers WHERE batch_no = 0 UNION ALL SELECT 1, seq, paperId, batch_no FROM papers WHERE batch_no > 0)
SELECT seq, paperId, batch_no FROM u WHERE coalesce(paperId, '') NOT IN ('', '0') QUALIFY row_number() OVER (PARTITION BY paperId ORDER BY f, seq) = 1"""
)
def merge_corpora(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select("seq", "paperId", "batch_no")
    return corpus.merge_corpora(p.where("batch_no = 0"), p.where("batch_no > 0"), "paperId", "seq")


@query("SELECT seq, paperId, coalesce(citationCount, 0) AS citations FROM papers ORDER BY citations DESC, seq LIMIT 1000")
def citation_rank(spark: SparkSession, d: str) -> DataFrame:
    return corpus.by_citations(table(spark, d, "papers"), 1000).select("seq", "paperId", F.coalesce("citationCount", F.lit(0)).alias("citations"))


_SCREENED = f"""WITH p AS (SELECT seq, {_id("paperId")} AS k, citationCount, venue FROM papers WHERE {_id("paperId")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_id("paperId")} ORDER BY seq) = 1),
s AS (SELECT {_id("paperId")} AS k, relevant, confidence FROM screenings WHERE {_id("paperId")} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_id("paperId")} ORDER BY screened_at DESC, seq DESC) = 1),
j AS (SELECT p.*, relevant, confidence FROM p JOIN s ON s.k = p.k)"""


def _screened(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers").select("seq", id_form(F.col("paperId")).alias("paper_key"), "citationCount", "venue")
    p = corpus.keep_first(p, F.col("paper_key"), F.col("seq"))
    return p.join(corpus.latest_screening(table(spark, d, "screenings"), id_form(F.col("paperId"))), "paper_key")


@query(f"{_SCREENED} SELECT seq, round(confidence * (1 + sqrt(coalesce(citationCount, 0)::DOUBLE)), 9) AS relevance FROM j WHERE relevant AND confidence >= 0.7 ORDER BY confidence * (1 + sqrt(coalesce(citationCount, 0)::DOUBLE)) DESC, seq LIMIT 150")
def relevance_rank(spark: SparkSession, d: str) -> DataFrame:
    return corpus.by_relevance(corpus.relevant(_screened(spark, d)), 150).select("seq", F.round("relevance", 9).alias("relevance"))


@query(f"SELECT year, count(*) AS papers, round(avg(citationCount), 6) AS mean_citations, round(avg(CASE WHEN TRUE THEN {_words('abstract')} END), 6) AS mean_abstract_words FROM papers GROUP BY year")
def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.corpus_summary(table(spark, d, "papers")).withColumns({"mean_citations": F.round("mean_citations", 6), "mean_abstract_words": F.round("mean_abstract_words", 6)})


_t = lambda c: f"CASE WHEN {c} NOT IN ('', '0') THEN {c} END"


@query(
    f"""WITH p AS (SELECT seq, {_t("paperId")} AS id, {_t("abstract")} AS abstract, coalesce(title, '') AS title, {_t("externalIds['DOI']")} AS doi, {_t("externalIds['CorpusId']")} AS cid FROM papers),
t AS (SELECT {_t("source_paper_id")} AS id, {_t("evidence")} AS evidence FROM triples),
a AS (SELECT id, arg_max_null(abstract, seq) AS abstract FROM p WHERE id IS NOT NULL GROUP BY id)
SELECT 'papers' AS measure, count(*) AS value FROM p UNION ALL SELECT 'unique_paper_ids', count(DISTINCT id) FROM p UNION ALL SELECT 'papers_with_abstract', count(abstract) FROM p
UNION ALL SELECT 'papers_with_doi', count(doi) FROM p UNION ALL SELECT 'papers_with_corpus_id', count(cid) FROM p UNION ALL SELECT 'duplicate_titles', count(*) - count(DISTINCT lower(title)) FROM p
UNION ALL SELECT 'triples', count(*) FROM t UNION ALL SELECT 'triples_with_paper_id', count(id) FROM t UNION ALL SELECT 'unique_triple_paper_ids', count(DISTINCT id) FROM t UNION ALL SELECT 'triples_with_evidence', count(evidence) FROM t
UNION ALL SELECT 'evidence_exact_substring_of_source_abstract', count(*) FROM t JOIN a ON a.id = t.id WHERE contains(lower(abstract), lower(evidence))
UNION ALL SELECT 'triple_paper_ids_not_in_corpus', count(DISTINCT t.id) FROM t LEFT JOIN a ON a.id = t.id WHERE a.id IS NULL"""
)
def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.audit(table(spark, d, "papers"), table(spark, d, "triples"))


@query(
    f"""WITH w AS (SELECT doc_id, string_split({_clean("text")}, ' ') AS w FROM documents WHERE {_clean("text")} <> ''),
c AS (SELECT doc_id, w, unnest(range(0, len(w), 80)) AS s FROM w)
SELECT doc_id, s // 80 AS chunk_no, array_to_string(w[s + 1 : s + 100], ' ') AS chunk FROM c"""
)
def chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 100 words, 20 of them shared."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(chunk_words(F.col("text"), 100, 20)).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no").cast("bigint"))


_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_TOK = "list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda x: x NOT IN {stop})".replace("{stop}", _STOP)


def token_sql(column: str) -> str:
    """Distinct tokens of a column (tokens()) in DuckDB."""
    t = _TOK.format(c=column)
    return f"list_distinct(list_concat({t}, list_filter(list_transform({t}, lambda x: regexp_replace(x, '[0-9]+$', '')), lambda x: x <> '' AND x NOT IN {_STOP})))"


@query(f"SELECT token, count(*) AS papers FROM (SELECT unnest({token_sql('title')}) AS token FROM papers WHERE title IS NOT NULL) GROUP BY token")
def title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select(F.explode(tokens(F.col("title"))).alias("token")).groupBy("token").agg(F.count("*").alias("papers"))


@query(
    f"""WITH a AS (SELECT DISTINCT unnest({token_sql("title")}) AS token FROM papers WHERE title IS NOT NULL), b AS (SELECT DISTINCT unnest({token_sql("subject.name")}) AS token FROM triples WHERE subject.name IS NOT NULL)
SELECT round(count(*) FILTER (WHERE a.token IS NOT NULL AND b.token IS NOT NULL) / count(*), 9) AS jaccard FROM a FULL JOIN b ON a.token = b.token"""
)
def jaccard_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "papers").select(F.explode(tokens(F.col("title"))).alias("token"))
    b = table(spark, d, "triples").select(F.explode(tokens(F.col("subject.name"))).alias("token"))
    return evaluation.token_jaccard(a, b).select(F.round("jaccard", 9).alias("jaccard"))


_PER = "SELECT year(screened_at) AS y, sum((relevant AND confidence >= 0.5)::INT) AS tp, sum((NOT relevant AND confidence >= 0.5)::INT) AS fp, sum((relevant AND confidence < 0.5)::INT) AS fn, sum((NOT relevant AND confidence < 0.5)::INT) AS tn FROM screenings WHERE relevant IS NOT NULL AND confidence IS NOT NULL GROUP BY 1"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "screenings").where("relevant is not null and confidence is not null")
    return s.select("seq", F.year("screened_at").alias("y"), F.month("screened_at").alias("m"), F.col("relevant").cast("int").alias("label"), (F.col("confidence") >= 0.5).cast("int").alias("prediction"), F.col("confidence").alias("score"))


@query(
    f"""WITH c AS ({_PER}), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c)
SELECT y, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(pr, 9) AS precision, round(rc, 9) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 9) AS f1 FROM p"""
)
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Screening confidence as a classifier of relevance, by year."""
    x = evaluation.confusion(_judged(spark, d), "y")
    return x.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(
    f"""WITH c AS ({_PER}), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c),
f AS (SELECT CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM p), g AS (SELECT avg(f1) AS m, coalesce(1.96 * stddev_samp(f1) / sqrt(count(*)), 0) AS h FROM f)
SELECT round(m, 9) AS mean_f1, round(greatest(m - h, 0), 9) AS low, round(least(m + h, 1), 9) AS high FROM g"""
)
def mean_f1(spark: SparkSession, d: str) -> DataFrame:
    x = evaluation.mean_f1(evaluation.confusion(_judged(spark, d), "y"))
    return x.select(*[F.round(c, 9).alias(c) for c in x.columns])


@query(
    """WITH s AS (SELECT year(screened_at) AS y, month(screened_at) AS m, seq, relevant::INT AS label, confidence AS score FROM screenings WHERE relevant IS NOT NULL AND confidence IS NOT NULL),
r AS (SELECT *, row_number() OVER o AS r, sum(label) OVER (PARTITION BY y, m ORDER BY score DESC, seq ROWS UNBOUNDED PRECEDING) AS hits, row_number() OVER (PARTITION BY y, m ORDER BY label DESC, seq) AS i, count(*) OVER (PARTITION BY y, m) AS n FROM s WINDOW o AS (PARTITION BY y, m ORDER BY score DESC, seq)),
g AS (SELECT y, m, sum(CASE WHEN r <= 20 THEN label ELSE 0 END) AS found, sum(label) AS pos, least(max(n), 20) AS k, sum(CASE WHEN r <= 20 THEN label / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 20 THEN label / log2(i + 1) ELSE 0 END) AS idcg, sum(CASE WHEN label = 1 THEN hits / r ELSE 0 END) AS ap FROM r GROUP BY y, m)
SELECT y, m, round(found / greatest(k, 1), 6) AS precision_at_k, round(found / greatest(pos, 1), 6) AS recall_at_k, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg_at_k, round(ap / greatest(pos, 1), 6) AS average_precision FROM g"""
)
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Confidence as a ranking of relevance, k = 20, by month."""
    x = evaluation.ranking(_judged(spark, d), ["y", "m"], 20)
    return x.select("y", "m", *[F.round(c, 6).alias(c) for c in x.columns[2:]])


_REVIEW = "CASE WHEN relevant IS NULL OR confidence IS NULL THEN 'Pending' WHEN relevant AND confidence >= 0.7 THEN 'Accept' WHEN relevant THEN 'Modify' ELSE 'Reject' END"


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d).select("seq", F.expr(_REVIEW).alias("decision"))


@query(
    f"""{_SCREENED}, r AS (SELECT {_REVIEW} AS d FROM j), c AS (SELECT count(*) FILTER (WHERE d = 'Accept') AS accept, count(*) FILTER (WHERE d = 'Modify') AS modify, count(*) FILTER (WHERE d = 'Reject') AS reject, count(*) FILTER (WHERE d = 'Pending') AS pending, count(*) AS total FROM r)
SELECT *, round(accept / nullif(accept + modify + reject, 0), 9) AS acceptance_rate, pending = 0 AND total > 0 AS complete FROM c"""
)
def review_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.review_summary(_reviews(spark, d)).withColumn("acceptance_rate", F.round("acceptance_rate", 9))


_STATUS = "CASE WHEN year IS NULL THEN 'rejected' WHEN coalesce(citationCount, 0) = 0 THEN 'review_required' ELSE 'automatically_eligible' END"


@query(
    f"""{_SCREENED}, x AS (SELECT {_STATUS} AS status, coalesce({_REVIEW.replace("relevant", "j.relevant").replace("confidence", "j.confidence")}, 'Pending') AS d FROM papers q LEFT JOIN j ON j.seq = q.seq)
SELECT s.status, count(*) FILTER (WHERE d = 'Accept') AS accept, count(*) FILTER (WHERE d = 'Modify') AS modify, count(*) FILTER (WHERE d = 'Reject') AS reject, count(*) FILTER (WHERE d = 'Pending') AS pending
FROM (VALUES ('review_required'), ('rejected'), ('automatically_eligible')) s(status) LEFT JOIN x ON x.status = s.status GROUP BY 1""".replace("papers q", "(SELECT seq, year, citationCount FROM papers) q").replace("CASE WHEN year", "CASE WHEN q.year").replace("coalesce(citationCount, 0) = 0 THEN 'review", "coalesce(q.citationCount, 0) = 0 THEN 'review")
)
def review_crosstab(spark: SparkSession, d: str) -> DataFrame:
    decisions = table(spark, d, "papers").select("seq", F.expr(_STATUS).alias("status"))
    return evaluation.crosstab(decisions, _reviews(spark, d), "seq")


@query(
    """WITH u AS (SELECT seq, batch_no, (('0x' || substr(md5('42|' || seq), 1, 8))::BIGINT / 4294967296.0) AS draw FROM papers),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY draw, seq) AS turn FROM u)
SELECT seq, batch_no, turn FROM r WHERE turn <= 60 ORDER BY turn, batch_no LIMIT 60"""
)
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """60 papers, in turn from every batch."""
    return evaluation.stratified_sample(table(spark, d, "papers").select("seq", "batch_no"), ["batch_no"], 60, "seq").select("seq", "batch_no", "turn")


@query("SELECT relation, count(*) AS kept FROM triples WHERE (('0x' || substr(md5('42|edge|1|' || seq), 1, 8))::BIGINT / 4294967296.0) <= 0.95 GROUP BY relation")
def edge_draws(spark: SparkSession, d: str) -> DataFrame:
    """One replicate of the edge-dropout sampler over every relation event."""
    kept = uniform(F.lit(42), F.lit("edge"), F.lit(1), F.col("seq")) <= 0.95
    return table(spark, d, "triples").where(kept).groupBy("relation").agg(F.count("*").alias("kept"))


@query("SELECT try_cast(regexp_extract(source_year, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INTEGER) AS year, count(*) AS triples FROM triples GROUP BY 1")
def triple_years(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples").groupBy(strict_year(F.col("source_year")).alias("year")).agg(F.count("*").alias("triples"))


@query("SELECT source AS method, count(*) AS outputs, count(DISTINCT text) AS unique_outputs, round(avg(CASE WHEN text IS NULL THEN NULL ELSE " + _words("text") + " END), 6) AS mean_words, count(DISTINCT doc_id) AS papers FROM documents GROUP BY source")
def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("source").alias("method"), F.col("doc_id").alias("paper_id"), "text")
    return evaluation.method_comparison(docs).withColumn("mean_words", F.round("mean_words", 6))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events, count(DISTINCT user_id) AS users, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling one-day windows of the events table; the streaming form is in lacuna.streaming."""
    from lacuna.streaming.windows import tumbling

    return tumbling(table(spark, d, "events"), "1 day")


_SIM = """WITH t AS (SELECT seq AS doc, unnest(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]{2,}')) AS term FROM papers WHERE title IS NOT NULL),
f AS (SELECT doc, term, count(*) AS tf FROM t WHERE term NOT IN {stop} GROUP BY 1, 2),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM papers WHERE title IS NOT NULL)) / (1 + count(*))) + 1 AS idf FROM f GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 10000),
w AS (SELECT doc, f.term, tf * idf AS w FROM f JOIN v ON v.term = f.term), n AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w),
s AS (SELECT q.doc AS query, x.doc, round(sum(q.w * x.w), 6) AS similarity FROM n q JOIN n x ON x.term = q.term AND x.doc <> q.doc WHERE q.doc % 20 = 0 GROUP BY 1, 2)
SELECT query, doc, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM s QUALIFY rank <= 3""".replace("{stop}", _STOP)


@query(_SIM)
def tfidf_top3(spark: SparkSession, d: str) -> DataFrame:
    """The three titles nearest to every twentieth one, of all titles; tfidf_top3_abstracts searches the whole abstracts."""
    docs = table(spark, d, "papers").where("title is not null").select(F.col("seq").alias("doc"), F.col("title").alias("text"))
    return retrieval.top_similar(retrieval.tfidf(docs), docs.where("doc % 20 = 0").select(F.col("doc").alias("query")), digits=6)


@query(_SIM.replace("title", "abstract"))
def tfidf_top3_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """The three abstracts nearest to every twentieth one, of all abstracts, with or without a title."""
    docs = table(spark, d, "papers").where("abstract is not null").select(F.col("seq").alias("doc"), F.col("abstract").alias("text"), (F.col("seq") % 20 == 0).alias("asks"))
    return retrieval.nearest_texts(docs, digits=6)


@query(
    """WITH v AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT doc, e, sqrt(list_dot_product(e, e)) AS l FROM v),
s AS (SELECT q.doc AS query, x.doc, list_dot_product(q.e, x.e) / (q.l * x.l) AS similarity FROM n q JOIN n x ON q.doc <> x.doc WHERE q.doc % 20 = 0)
SELECT query, doc, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, doc) AS rank FROM s QUALIFY rank <= 3"""
)
def embedding_top3(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vec"))
    return retrieval.nearest_vectors(v, v.where("doc % 20 = 0").select(F.col("doc").alias("query"))).withColumn("similarity", F.round("similarity", 6))


@query(
    """WITH v AS (SELECT vec_id AS doc, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT doc, e, sqrt(list_dot_product(e, e)) AS l FROM v)
SELECT x.doc AS x, y.doc AS y, round(list_dot_product(x.e, y.e) / (x.l * y.l), 6) AS score FROM n x JOIN n y ON x.doc < y.doc WHERE list_dot_product(x.e, y.e) / (x.l * y.l) >= 0.4"""
)
def embedding_similar(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of a cosine of at least 0.4 (the table's vectors are farther apart than those of names that mean the same)."""
    return retrieval.similar_vectors(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4).withColumn("score", F.round("score", 6))


@query("SELECT seq, title FROM papers WHERE contains(lower(concat_ws(' ', title, array_to_string(list_transform(authors, lambda a: coalesce(a.name, '')), ' '), venue, paperId)), 'gradient')")
def paper_search(spark: SparkSession, d: str) -> DataFrame:
    return corpus.search(table(spark, d, "papers"), "Gradient").select("seq", "title")


@query(f"SELECT n_words, count(*) AS papers FROM (SELECT {_words('abstract')} AS n_words FROM papers) GROUP BY 1")
def abstract_word_histogram(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").groupBy(word_count(F.col("abstract")).cast("bigint").alias("n_words")).agg(F.count("*").alias("papers"))
