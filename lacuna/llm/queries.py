"""Queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions.ids import id_form
from lacuna.functions.names import key_column
from lacuna.llm import chunking, components, history, mixing, spans, tokens, vocabulary, vptree
from lacuna.plans.runtime import Scratch, table

LIKENESS = 0.7
SHINGLE = 3
MIN_WORDS = 20


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "papers"), "abstract", "seq", 2000, 200)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).where("piece_no = 0").select("seq")


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """(seq, n_chars, pieces_fit, overlaps_fit, rebuilt): whether a text's pieces are within their limits, and the digest of the text rebuilt from them."""
    x = p1_pieces(spark, d).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece"))).alias("p"))  # the pieces of one text
    ahead = lambda i: F.when(i > 0, F.col("p")[i - 1]["end"]).otherwise(F.lit(0))
    new = F.transform("p", lambda p, i: F.substr(p["piece"], ahead(i) - p["start"] + 1))
    shared = F.forall(F.transform("p", lambda p, i: ahead(i) - p["start"]), lambda n: (n >= 0) & (n <= 200))
    fit = F.forall("p", lambda p: (F.length(p["piece"]) <= 2000) & (F.length(p["piece"]) == p["end"] - p["start"]))
    whole = F.array_join(new, "")
    return x.select("seq", F.length(whole).cast("bigint").alias("n_chars"), fit.alias("pieces_fit"), shared.alias("overlaps_fit"), F.md5(whole).alias("rebuilt"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct raw pairs are taken before the names are normalised."""
    m = table(spark, d, "name_matches").where(F.lower(F.trim(F.regexp_replace("verdict", r"^\s+|\s+$", ""))) == "match")
    raw = m.select("name_a", "name_b").where("name_a is not null and name_b is not null").distinct()
    keys = raw.select(key_column(F.col("name_a")).alias("a"), key_column(F.col("name_b")).alias("b")).where("a != '' and b != ''")
    return components.connected_components(keys, "a", "b", "name_key", "group_key")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, same = vptree.near_duplicates(table(spark, d, "papers"), "seq", ["title", "abstract"], LIKENESS, SHINGLE, MIN_WORDS)
    return vptree.expanded(pairs, same)


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """(seq, class, group_key, links): one row for each row in a group, copies by their class."""
    pairs, same = vptree.near_duplicates(table(spark, d, "papers"), "seq", ["title", "abstract"], LIKENESS, SHINGLE, MIN_WORDS)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    group = components.connected_components(pairs, "a", "b", "class", "group_key")
    linked = group.join(links, "class")
    rows = same.select(F.col("rep").alias("class"), F.col("key").alias("seq")).unionByName(linked.select("class", F.col("class").alias("seq"))).distinct()
    return rows.join(linked, "class", "left").select("seq", "class", F.coalesce("group_key", "class").alias("group_key"), F.coalesce("links", F.lit(0)).alias("links"))


def _screened(spark: SparkSession, d: str, ends: tuple[int, ...]) -> DataFrame:
    """(seq, accepted) by one append to an index for the batches up to each of ``ends`` and one for the rest."""
    papers = table(spark, d, "papers").withColumn("id", id_form(F.col("paperId"))).withColumn("batch", F.coalesce("batch_no", F.lit(-1)))
    index = history.Index(spark, f"{Scratch(spark, 'index').root}/index", ["title", "abstract"], "id", LIKENESS, SHINGLE, MIN_WORDS)
    out, low = None, None
    for high in (*ends, None):
        step = papers.where("true" if low is None else f"batch > {low}").where("true" if high is None else f"batch <= {high}")
        done = index.add(step, "seq", [F.col("batch")])
        out, low = done if out is None else out.unionByName(done), high
    return out


def p5_decisions(spark: SparkSession, d: str) -> DataFrame:
    """(seq, accepted) of every papers row: the first collection goes into an index, the later batches are screened against it and appended."""
    return _screened(spark, d, (0,))


def p5_appends(spark: SparkSession, d: str) -> DataFrame:
    """The same by four appends: the first collection, then eight batches at a time."""
    return _screened(spark, d, (0, 8, 16))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_decisions(spark, d).where("not accepted").select("seq")


def _terms(spark: SparkSession, d: str) -> DataFrame:
    triples = table(spark, d, "triples")
    rows = triples.select(id_form(F.col("source_paper_id")).alias("rec"), key_column(F.col("subject.name")).alias("s"), key_column(F.col("object.name")).alias("o"))
    freq = vocabulary.frequencies(vocabulary.build_index(rows, "rec", "s", "o"))
    papers = triples.select(id_form(F.col("source_paper_id")).alias("rec")).where("rec is not null").distinct().agg(F.count("*"))
    return vocabulary.marked(freq, papers, rare_most=2, common_percent=1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select(F.col("term").alias("name_key"), "mark")


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select(F.col("term").alias("name_key"), F.col("n_first").alias("as_subject"), F.col("n_second").alias("as_object"), "occurrences", F.col("records").alias("papers"), "mark")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_column(table(spark, d, "documents"), "text", "doc_id")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.count_column(table(spark, d, "documents"), "text", ["doc_id", "source"])
    return mixing.mix(sized, table(spark, d, "source_targets"), "doc_id", "source", "n_tokens")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_shares_by_chars(spark: SparkSession, d: str) -> DataFrame:
    """p8_shares with characters for tokens, which SQL can count too."""
    sized = table(spark, d, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("n"))
    x = mixing.mix(sized, table(spark, d, "source_targets"), "doc_id", "source", "n")[1]
    return x.select("source", F.round("target_share", 9).alias("target_share"), F.round("actual_share", 9).alias("actual_share"), "max_repeats", F.col("most_copies").cast("int").alias("most_copies"), "docs", "docs_used", "tokens_available", F.round("tokens_target", 3).alias("tokens_target"), "tokens_mix")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text", 200).pairs()


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, n_chars, shared_chars) of every document of at least 200 characters."""
    return spans.SharedSpans(table(spark, d, "documents"), "doc_id", "text", 200).coverage().withColumnRenamed("doc", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_checks, p2_found, p3_found, p3_groups, p5_found, p5_decisions, p5_appends, p6_found, p6_terms, p7_ids, p8_mix, p8_shares, p8_shares_by_chars, p9_found, p9_shared)}


_P3 = """WITH w AS (SELECT seq, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '[\\p{L}\\p{N}]+') AS w FROM papers),
s AS (SELECT DISTINCT seq, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT seq, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
n AS (SELECT seq, count(*) AS n FROM s GROUP BY seq),
c AS (SELECT a.seq AS seq_a, b.seq AS seq_b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.seq < b.seq GROUP BY 1, 2)
SELECT seq_a, seq_b FROM c JOIN n x ON x.seq = seq_a JOIN n y ON y.seq = seq_b WHERE i >= 0.7 * (x.n + y.n - i) - 1e-9"""

_P3_GROUPS = "WITH RECURSIVE w AS" + _P3.removeprefix("WITH w AS").rsplit("\n", 1)[0] + """,
k AS (SELECT seq, list(g ORDER BY g) AS gs FROM s GROUP BY seq), cl AS (SELECT seq, min(seq) OVER (PARTITION BY gs) AS rep, count(*) OVER (PARTITION BY gs) AS copies FROM k),
p AS (SELECT seq_a AS a, seq_b AS b FROM c JOIN n x ON x.seq = seq_a JOIN n y ON y.seq = seq_b JOIN cl u ON u.seq = seq_a AND u.rep = seq_a JOIN cl v ON v.seq = seq_b AND v.rep = seq_b WHERE i >= 0.7 * (x.n + y.n - i) - 1e-9),
two AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT DISTINCT a AS node, a AS reach FROM two UNION SELECT r.node, two.b FROM r JOIN two ON two.a = r.reach),
grp AS (SELECT node, min(reach) AS group_key FROM r GROUP BY node), lk AS (SELECT a AS node, count(*) AS links FROM two GROUP BY a)
SELECT cl.seq, cl.rep AS class, coalesce(group_key, cl.rep) AS group_key, coalesce(links, 0) AS links FROM cl LEFT JOIN grp ON grp.node = cl.rep LEFT JOIN lk ON lk.node = cl.rep WHERE copies > 1 OR group_key IS NOT NULL"""

_P8 = r"""WITH d AS (SELECT lower(regexp_replace(source, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS source, length(text) AS n FROM documents WHERE source IS NOT NULL AND length(text) > 0),
have AS (SELECT source, count(*) AS docs, sum(n) AS tokens FROM d GROUP BY 1),
want AS (SELECT lower(regexp_replace(source, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')) AS source, sum(target_share) AS target_share, min(max_repeats) AS max_repeats FROM source_targets WHERE source IS NOT NULL GROUP BY 1),
u AS (SELECT w.*, coalesce(docs, 0) AS docs, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(tokens, 0) > 0 AND target_share > 0 AND max_repeats > 0 AS ok FROM want w LEFT JOIN have h ON h.source = w.source),
v AS (SELECT *, CASE WHEN ok THEN target_share ELSE 0 END / sum(CASE WHEN ok THEN target_share ELSE 0 END) OVER () AS share FROM u),
t AS (SELECT *, least(sum(CASE WHEN ok THEN tokens END) OVER (), min(CASE WHEN ok THEN max_repeats * tokens / share END) OVER ()) * share AS goal FROM v),
e AS (SELECT *, CASE WHEN ok THEN least(goal / tokens, max_repeats) ELSE 0 END AS rate, ('0x' || substr(md5('7|' || source), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM t),
r AS (SELECT d.source, n, row_number() OVER (PARTITION BY d.source ORDER BY n) AS r FROM d),
c AS (SELECT r.source, n, least(floor(r * rate + start) - floor((r - 1) * rate + start), max_repeats) AS copies FROM r JOIN e ON e.source = r.source WHERE rate > 0),
g AS (SELECT source, count(*) AS used, sum(copies * n) AS mix, max(copies) AS most FROM c WHERE copies > 0 GROUP BY 1)
SELECT e.source, round(target_share, 9) AS target_share, round(coalesce(mix, 0) / (SELECT sum(mix) FROM g), 9)::DOUBLE AS actual_share, max_repeats, coalesce(most, 0)::INTEGER AS most_copies, docs, coalesce(used, 0) AS docs_used, tokens AS tokens_available, round(coalesce(goal, 0), 3)::DOUBLE AS tokens_target, coalesce(mix, 0)::BIGINT AS tokens_mix
FROM e LEFT JOIN g ON g.source = e.source""".replace("\\\\", "\\")

_P9 = """WITH d AS (SELECT DISTINCT doc_id, substr(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT s FROM d GROUP BY s HAVING count(*) > 1), x AS (SELECT d.* FROM d JOIN m ON m.s = d.s)
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id"""


_P9_SHARED = """WITH d AS (SELECT doc_id, i, substr(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)),
m AS (SELECT s FROM d GROUP BY s HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM d WHERE s IN (SELECT s FROM m)),
c AS (SELECT doc_id, sum(least(200, i - coalesce(b, i - 200))) AS n FROM x GROUP BY doc_id)
SELECT t.doc_id, length(text) AS n_chars, coalesce(n, 0)::BIGINT AS shared_chars FROM documents t LEFT JOIN c ON c.doc_id = t.doc_id WHERE length(text) >= 200"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": "SELECT seq FROM papers WHERE length(abstract) > 2000", "p1_checks": "SELECT seq, length(abstract) AS n_chars, true AS pieces_fit, true AS overlaps_fit, md5(abstract) AS rebuilt FROM papers WHERE length(abstract) > 2000", "p3_found": _P3, "p3_groups": _P3_GROUPS, "p8_shares_by_chars": _P8, "p9_found": _P9, "p9_shared": _P9_SHARED}
