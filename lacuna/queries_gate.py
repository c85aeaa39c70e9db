"""Gate, stability and scoring queries over the whole graph, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.catalog import query
from lacuna.functions.text import GENERIC_PHRASES, specificity
from lacuna.operators import candidates, detect, evaluation, gate, graph, paths, score, stability
from lacuna.plans.runtime import Scratch, table
from lacuna.queries_corpus import token_sql
from lacuna.queries_graph import GREEDY_SQL, SNAPSHOT, community_membership, edges, sql

SETTINGS = gate.Settings(snapshot_date=SNAPSHOT)
_U = "(('0x' || substr(md5({0}), 1, 8))::BIGINT / 4294967296.0)"

_GENERIC = "(" + ", ".join(f"'{g}'" for g in GENERIC_PHRASES) + ")"


@query(
    sql(
        f"""SELECT node, round(CASE WHEN node IN {_GENERIC} OR len(t) = 0 THEN 0 ELSE 0.75 * (1 - len(list_filter(t, lambda x: x IN {_GENERIC})) / len(t)) + 0.25 * least(len(t) / 3.0, 1) END, 9) AS specificity FROM n""",
        f", n AS (SELECT node, {token_sql('node')} AS t FROM (SELECT DISTINCT node FROM ends))",
    )
)
def entity_specificity(spark: SparkSession, d: str) -> DataFrame:
    nodes = graph.endpoints(edges(spark, d)).select("node").distinct()
    return nodes.select("node", F.round(specificity(F.array("node")), 9).alias("specificity"))


_ENT = f""", ent AS (SELECT 'missing_link | ' || head || ' | ' || tail AS candidate, 'missing_link' AS family, unnest([0, 1]) AS no, unnest([head, tail]) AS label, NULL::INTEGER AS peak FROM links
  UNION ALL SELECT 'temporal_decay | ' || node, 'temporal_decay', 0, node, peak_year FROM decay WHERE CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END >= 0.3),
tk AS (SELECT *, {token_sql("label")} AS t FROM ent),
dt AS (SELECT DISTINCT doc, year, unnest({token_sql("text")}) AS token FROM (SELECT seq AS doc, year, lower(concat_ws(' ', nullif(title, ''), nullif(abstract, ''))) AS text FROM papers)),
grp AS (SELECT candidate, family, no, peak, len(t) AS k, unnest(t) AS token FROM tk WHERE len(t) > 0),
hit AS (SELECT candidate, family, no, peak, doc, year FROM grp JOIN dt USING (token) GROUP BY ALL, k HAVING count(*) >= greatest(1, ceil(k * 0.6 - 1e-9))),
ne AS (SELECT candidate, count(DISTINCT no) AS n FROM grp GROUP BY candidate),
clo AS (SELECT h.candidate, doc FROM hit h JOIN ne ON ne.candidate = h.candidate GROUP BY h.candidate, family, n, peak, doc, year
  HAVING (n >= 2 AND count(DISTINCT no) >= 2) OR (family = 'temporal_decay' AND n = 1 AND year > coalesce(peak, 0)))"""


def _detected(spark: SparkSession, d: str, scratch: Scratch, clusters: bool = True) -> tuple[DataFrame, DataFrame]:
    e = scratch.save(edges(spark, d), "edges")
    links = detect.common_neighbor_links(graph.simple(e))
    decays = detect.temporal_decay(e, snapshot_date=SNAPSHOT)
    if not clusters:
        return e, scratch.save(candidates.table(links, None, None, decays), "candidates")
    pairs, member = community_membership(spark, d)
    return e, scratch.save(candidates.table(links, detect.orphan_clusters(pairs, member), member, decays), "candidates")


def _docs(spark: SparkSession, d: str, normalise: bool = True) -> DataFrame:
    return gate.documents(table(spark, d, "papers"), "seq", normalise)


@query(sql("SELECT candidate, count(*) AS hits FROM clo GROUP BY candidate", _ENT.replace("GROUP BY ALL, k HAVING", "GROUP BY candidate, family, no, peak, doc, year, k HAVING")))
def closure_hits(spark: SparkSession, d: str) -> DataFrame:
    """Papers that already mention what a link or decay says is missing or in decline; SQL has no communities, so closure_hits_all has all families."""
    return _closure(spark, d, False, _docs(spark, d, normalise=False))


@query()
def closure_hits_all(spark: SparkSession, d: str) -> DataFrame:
    """Papers that already mention what a candidate of any family says, over texts in the form of labels, as the gate counts them."""
    return _closure(spark, d, True, _docs(spark, d))


@query(sql("SELECT candidate, doc, year, n FROM (SELECT candidate, c.doc, p.year, row_number() OVER (PARTITION BY candidate ORDER BY coalesce(p.year, 0) DESC, c.doc) AS place, count(*) OVER (PARTITION BY candidate) AS n FROM clo c JOIN (SELECT seq AS doc, year FROM papers) p ON p.doc = c.doc) WHERE place <= 10", _ENT.replace("GROUP BY ALL, k HAVING", "GROUP BY candidate, family, no, peak, doc, year, k HAVING")))
def closure_hit_list(spark: SparkSession, d: str) -> DataFrame:
    """The ten newest papers of those counted in closure_hits."""
    return gate.listed_hits(_hits(spark, d, False, _docs(spark, d, normalise=False)), SETTINGS)


def _closure(spark: SparkSession, d: str, clusters: bool, docs: DataFrame) -> DataFrame:
    return _hits(spark, d, clusters, docs).groupBy("candidate").agg(F.count("*").alias("hits"))


def _hits(spark: SparkSession, d: str, clusters: bool, docs: DataFrame) -> DataFrame:
    _, c = _detected(spark, d, Scratch(spark, "closure"), clusters)
    named = c.select("candidate", "family", F.posexplode(F.slice("entities", 1, 6)).alias("entity_no", "label"), "peak_year")
    return gate.closure_hits(named, docs)


_INC = """, con AS (SELECT node AS concept FROM decay WHERE CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END >= 0.3),
inc AS (SELECT concept, edge_seq, year, coalesce(source_paper, 'event-' || edge_seq) AS paper, source_paper IS NOT NULL AS has_paper FROM ends JOIN con ON concept = node),
rep AS (SELECT *, unnest(range(1, 21)) AS r FROM inc),
kept AS (SELECT * FROM rep WHERE {keep}),
y AS (SELECT concept, r, k.year, count(DISTINCT paper) / greatest(coalesce(max(publications), 0), 1) AS rate FROM kept k LEFT JOIN pubs p ON p.year = k.year WHERE k.year IS NOT NULL GROUP BY 1, 2, 3),
l AS (SELECT concept, r, max(year) AS last, count(*) AS n FROM y GROUP BY 1, 2),
g AS (SELECT y.concept, y.r, n, sum(CASE WHEN last - year < 2 THEN rate ELSE 0 END) AS recent, sum(CASE WHEN last - year BETWEEN 2 AND 3 THEN rate ELSE 0 END) AS earlier FROM y JOIN l ON l.concept = y.concept AND l.r = y.r GROUP BY 1, 2, 3),
ok AS (SELECT concept, count(*) AS s FROM g WHERE n >= 2 AND CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END >= 0.3 GROUP BY 1)"""


def _decay_stability(spark: SparkSession, d: str, mode: str, keep: float = 0.8, repeats: int = 20) -> DataFrame:
    scratch = Scratch(spark, "stability")
    e = scratch.save(edges(spark, d), "edges")
    concepts = detect.temporal_decay(e, snapshot_date=SNAPSHOT).select("concept")
    ev = scratch.save(stability.incident(e, concepts), "events")
    x = stability.decay_survival(ev, detect.papers_per_year(e), mode, None, keep, repeats=repeats)
    return x.withColumn("survival", F.round("survival", 9))


_SURVIVAL = "SELECT con.concept, round(coalesce(s, 0) / 20.0, 9)::DOUBLE AS survival FROM con LEFT JOIN ok ON ok.concept = con.concept WHERE con.concept IN (SELECT concept FROM inc)"


@query(sql(_SURVIVAL, _INC.replace("{keep}", _U.format("'42|edge|' || r || '|' || concept || '|' || edge_seq") + " <= 0.8")))
def edge_dropout_stability(spark: SparkSession, d: str) -> DataFrame:
    """Share of 20 replicates in which a decline survives the loss of a fifth of the relation events; edge_dropout_stability_gate has the gate's settings."""
    return _decay_stability(spark, d, "edge")


@query(sql(_SURVIVAL, _INC.replace("{keep}", "has_paper AND " + _U.format("'42|paper|' || r || '|' || concept || '|' || paper") + " <= 0.8")))
def paper_dropout_stability(spark: SparkSession, d: str) -> DataFrame:
    """The same for papers; paper_dropout_stability_gate has the gate's settings."""
    return _decay_stability(spark, d, "paper")


_SURVIVAL_GATE, _INC_GATE = _SURVIVAL.replace("/ 20.0", "/ 50.0"), _INC.replace("range(1, 21)", "range(1, 51)")


@query(sql(_SURVIVAL_GATE, _INC_GATE.replace("{keep}", _U.format("'42|edge|' || r || '|' || concept || '|' || edge_seq") + " <= 0.95")))
def edge_dropout_stability_gate(spark: SparkSession, d: str) -> DataFrame:
    """Share of the gate's 50 replicates in which a decline survives the loss of a twentieth of the relation events."""
    return _decay_stability(spark, d, "edge", SETTINGS.edge_keep, SETTINGS.repeats)


@query(sql(_SURVIVAL_GATE, _INC_GATE.replace("{keep}", "has_paper AND " + _U.format("'42|paper|' || r || '|' || concept || '|' || paper") + " <= 0.95")))
def paper_dropout_stability_gate(spark: SparkSession, d: str) -> DataFrame:
    """The same for papers."""
    return _decay_stability(spark, d, "paper", SETTINGS.paper_keep, SETTINGS.repeats)


_LINK_SURVIVAL = ",\n" + """reps AS (SELECT unnest(range(1, 51)) AS r),
it AS (SELECT head, tail, path_no, unnest(items) AS x FROM ind),
keeps AS (SELECT head, tail, path_no, r, bool_and({U_EDGE} <= 0.95) FILTER (WHERE starts_with(x, 'edge~')) AS e_ok, bool_and({U_PAPER} <= 0.95) FILTER (WHERE starts_with(x, 'paper~')) AS p_ok FROM it CROSS JOIN reps GROUP BY 1, 2, 3, 4),
held AS (SELECT head, tail, r, count(*) FILTER (WHERE e_ok) AS ne, count(*) FILTER (WHERE p_ok) AS np FROM keeps GROUP BY 1, 2, 3),
pool AS (SELECT DISTINCT head, tail, edge_seq AS item FROM links JOIN (SELECT unnest([u, v]) AS node, edge_seq, lower(coalesce(evidence, '')) AS ev FROM e) ON node = head WHERE contains(ev, tail)),
npaths AS (SELECT head, tail, count(*) AS n FROM ind GROUP BY 1, 2),
closing AS (SELECT n.head, n.tail, r, n, coalesce(bool_or({U_ADD} <= 0.5), false) AS closed FROM npaths n CROSS JOIN reps LEFT JOIN pool p ON p.head = n.head AND p.tail = n.tail GROUP BY 1, 2, 3, 4),
sa AS (SELECT head, tail, count(*) FILTER (WHERE NOT closed AND n >= 1) / 50.0 AS s_add FROM closing GROUP BY 1, 2),
se AS (SELECT head, tail, count(*) FILTER (WHERE ne >= 1) / 50.0 AS s_edge, count(*) FILTER (WHERE np >= 1) / 50.0 AS s_paper FROM held GROUP BY 1, 2)""".replace("{U_EDGE}", _U.format("'42|edge|' || r || '|' || head || '|' || tail || '|' || substr(x, 6)")).replace("{U_PAPER}", _U.format("'42|paper|' || r || '|' || head || '|' || tail || '|' || substr(x, 7)")).replace("{U_ADD}", _U.format("'42|add|' || r || '|' || n.head || '|' || n.tail || '|' || p.item"))


@query(sql("SELECT head, tail, s_edge::DOUBLE AS edge_deletion, s_paper::DOUBLE AS paper_dropout, s_add::DOUBLE AS plausible_edge_addition, least(s_edge, s_paper, s_add)::DOUBLE AS aggregate FROM se JOIN sa USING (head, tail)", GREEDY_SQL + _LINK_SURVIVAL).replace("WITH e0", "WITH RECURSIVE e0"))
def link_stability(spark: SparkSession, d: str) -> DataFrame:
    """Survival of the top link candidates by mode."""
    scratch = Scratch(spark, "links")
    e = scratch.save(edges(spark, d), "edges")
    links = scratch.save(detect.common_neighbor_links(graph.simple(e)), "links")
    sources = scratch.save(paths.edge_papers(e), "sources")
    p = scratch.save(paths.independent_paths(e, links, 4, sources), "paths")
    a = stability.link_survival(paths.path_edges(p), "edge").withColumnRenamed("survival", "edge_deletion")
    b = stability.link_survival(paths.path_papers(p, sources), "paper").withColumnRenamed("survival", "paper_dropout")
    n = p.groupBy("head", "tail").agg(F.count("*").alias("paths"))
    c = stability.link_addition_survival(n, candidates.plausible_direct(e, links)).withColumnRenamed("survival", "plausible_edge_addition")
    return a.join(b, ["head", "tail"]).join(c, ["head", "tail"]).withColumn("aggregate", F.least("edge_deletion", "paper_dropout", "plausible_edge_addition"))


def _decisions(spark: SparkSession, d: str, clusters: bool = True) -> tuple[DataFrame, DataFrame]:
    """(edges, decisions); without clusters texts are compared as stored, as SQL can do it."""
    scratch = Scratch(spark, "gate")
    e, c = _detected(spark, d, scratch, clusters)
    return e, scratch.save(gate.decide(candidates.facts(e, c, _docs(spark, d, clusters), SETTINGS, searched=True), SETTINGS), "decisions")


def _shown(x: DataFrame) -> DataFrame:
    return x.select("candidate", "family", "status", F.round("ranking_score", 8).alias("ranking_score"), F.array_join("reasons", ",").alias("reasons"), F.col("papers").cast("bigint").alias("papers"), F.col("paths").cast("bigint").alias("paths"), F.round("stability", 8).alias("stability"), F.round("specificity", 8).alias("specificity"), "closure_hits")


def _ranked(e: DataFrame, x: DataFrame) -> DataFrame:
    x = x.where("status != 'rejected'")
    x = x.join(candidates.mean_centrality(x, graph.degree_centrality(e)), "candidate", "left")
    return score.rank_candidates(x, 30, tie="candidate").select("rank", "candidate", "family", F.round("raw_composite_score", 8).alias("raw_composite_score"), F.round("composite_score", 8).alias("composite_score"))


def _dropout_sql(name: str, keep: str) -> str:
    """Survival of declines against papers per year of the corpus, up to the end year."""
    return f"""kept_{name} AS (SELECT * FROM rep WHERE {keep}),
y_{name} AS (SELECT concept, r, k.year, count(DISTINCT paper) / greatest(coalesce(max(publications), 0), 1) AS rate FROM kept_{name} k LEFT JOIN dpubs p ON p.year = k.year WHERE k.year IS NOT NULL GROUP BY 1, 2, 3),
l_{name} AS (SELECT concept, r, least(max(year), (SELECT y FROM final_year)) AS last, count(*) AS n FROM y_{name} GROUP BY 1, 2),
g_{name} AS (SELECT y.concept, y.r, n, sum(CASE WHEN last - year BETWEEN 0 AND 1 THEN rate ELSE 0 END) AS recent, sum(CASE WHEN last - year BETWEEN 2 AND 3 THEN rate ELSE 0 END) AS earlier FROM y_{name} y JOIN l_{name} l ON l.concept = y.concept AND l.r = y.r GROUP BY 1, 2, 3),
ok_{name} AS (SELECT concept, count(*) / 50.0 AS s FROM g_{name} WHERE n >= 2 AND least(greatest(CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END, 0), 1) >= 0.3 GROUP BY 1)"""


_TYPED = "regexp_replace({0}, '(?: ?\\[ ?(?:method|dataset|metric|concept|finding|tool|unknown) ?\\] ?)+$', '')"

#: The gate's facts and decisions for links and declines; SQL has no communities.
_GATE = GREEDY_SQL + _LINK_SURVIVAL + _ENT.replace("GROUP BY ALL, k HAVING", "GROUP BY candidate, family, no, peak, doc, year, k HAVING") + _INC.replace("range(1, 21)", "range(1, 51)").split(",\nkept AS")[0] + ",\n" + f"""dpubs AS (SELECT year, count(*) AS publications FROM papers WHERE year IS NOT NULL AND concat_ws(' ', nullif(title, ''), nullif(abstract, '')) <> '' GROUP BY year),
final_year AS (SELECT CASE WHEN max(year) = {SNAPSHOT[:4]} THEN max(year) - 1 ELSE max(year) END AS y FROM dpubs),
{_dropout_sql("edge", _U.format("'42|edge|' || r || '|' || concept || '|' || edge_seq") + " <= 0.95")},
{_dropout_sql("paper", "has_paper AND " + _U.format("'42|paper|' || r || '|' || concept || '|' || paper") + " <= 0.95")},
hits AS (SELECT candidate, count(*) AS n FROM clo GROUP BY candidate),
spec AS (SELECT candidate, avg(CASE WHEN label IN {_GENERIC} OR len(t) = 0 THEN 0 ELSE 0.75 * (1 - len(list_filter(t, lambda x: x IN {_GENERIC})) / len(t)) + 0.25 * least(len(t) / 3.0, 1) END) AS specificity FROM tk GROUP BY candidate),
pp AS (SELECT head, tail, count(DISTINCT x) FILTER (WHERE starts_with(x, 'paper~')) AS papers FROM (SELECT head, tail, unnest(items) AS x FROM ind) GROUP BY 1, 2),
fact AS (
  SELECT 'missing_link | ' || l.head || ' | ' || l.tail AS candidate, 'missing_link' AS family, coalesce(pp.papers, 0) AS papers, coalesce(npaths.n, 0) AS paths, coalesce(s_edge, 0) AS s1, coalesce(s_paper, 0) AS s2, coalesce(s_add, 0) AS s3, true AS searched,
    {_TYPED.format("l.head")} = {_TYPED.format("l.tail")} AS self_link
  FROM links l LEFT JOIN pp USING (head, tail) LEFT JOIN npaths USING (head, tail) LEFT JOIN se USING (head, tail) LEFT JOIN sa USING (head, tail)
  UNION ALL
  SELECT 'temporal_decay | ' || con.concept, 'temporal_decay', coalesce(i.papers, 0), 0, coalesce(a.s, 0), coalesce(b.s, 0), NULL, false, false
  FROM con LEFT JOIN (SELECT concept, count(DISTINCT paper) FILTER (WHERE has_paper) AS papers FROM inc GROUP BY 1) i ON i.concept = con.concept LEFT JOIN ok_edge a ON a.concept = con.concept LEFT JOIN ok_paper b ON b.concept = con.concept),
met AS (SELECT f.candidate, family, papers, paths, least(s1, s2, coalesce(s3, s1)) AS stability, specificity, coalesce(h.n, 0) AS closure_hits, searched, self_link FROM fact f JOIN spec USING (candidate) LEFT JOIN hits h USING (candidate)),
why AS (SELECT *, list_filter([
    CASE WHEN self_link THEN 'canonical_self_link' END, CASE WHEN papers < 2 THEN 'insufficient_independent_paper_support' END, CASE WHEN specificity < 0.55 THEN 'generic_or_underspecified_entities' END,
    CASE WHEN stability < 0.7 THEN 'unstable_under_multi_mode_perturbation' END, CASE WHEN family = 'missing_link' AND paths < 2 THEN 'insufficient_source_disjoint_evidence_paths' END,
    CASE WHEN closure_hits > 0 THEN 'possible_prior_coverage_found_in_local_corpus' END, CASE WHEN NOT searched THEN 'plausible_edge_stress_unavailable' END], lambda x: x IS NOT NULL) AS reasons,
  0.25 * least(papers / 2, 1) + 0.15 * specificity + 0.2 * CASE WHEN family = 'missing_link' THEN least(paths / 2, 1) ELSE 1 END + 0.3 * stability + CASE WHEN closure_hits = 0 THEN 0.1 ELSE 0 END AS ranking_score FROM met),
dec AS (SELECT *, CASE WHEN len(list_filter(reasons, lambda x: x NOT IN ('possible_prior_coverage_found_in_local_corpus', 'plausible_edge_stress_unavailable'))) > 0 THEN 'rejected' WHEN len(reasons) > 0 THEN 'review_required' ELSE 'automatically_eligible' END AS status FROM why)"""
_recursive = lambda body, more="": sql(body, _GATE + more).replace("WITH e0", "WITH RECURSIVE e0")


@query(_recursive("SELECT candidate, family, status, round(ranking_score, 8) AS ranking_score, array_to_string(reasons, ',') AS reasons, papers, paths, round(stability, 8)::DOUBLE AS stability, round(specificity, 8) AS specificity, closure_hits FROM dec"))
def gate_decisions(spark: SparkSession, d: str) -> DataFrame:
    """The gate on links and declines; SQL has no communities, so gate_decisions_all has all families."""
    return _shown(_decisions(spark, d, False)[1])


@query()
def gate_decisions_all(spark: SparkSession, d: str) -> DataFrame:
    """The gate on candidates of all families, over texts in the form of labels."""
    return _shown(_decisions(spark, d)[1])


@query(_recursive("SELECT status, count(*) AS candidates FROM dec GROUP BY status"))
def gate_status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links and declines by status; gate_status_counts_all has all families."""
    return gate.status_counts(_decisions(spark, d, False)[1])


@query()
def gate_status_counts_all(spark: SparkSession, d: str) -> DataFrame:
    return gate.status_counts(_decisions(spark, d)[1])


_RANKED = """, dgc AS (SELECT node, count(*) / (SELECT count(DISTINCT node) - 1 FROM ends) AS c FROM (SELECT unnest([u, v]) AS node FROM (SELECT DISTINCT u, v FROM e)) GROUP BY node),
cen AS (SELECT candidate, avg(coalesce(c, 0)) AS c FROM ent LEFT JOIN dgc ON node = label GROUP BY candidate),
pd AS (SELECT 'missing_link | ' || head || ' | ' || tail AS candidate, least(abs(prediction_score) / 10, 1) AS own FROM links UNION ALL SELECT 'temporal_decay | ' || node, 1 - recent / earlier FROM decay WHERE earlier > 0),
sc AS (SELECT candidate, family, (0.15 * c + 0.25 * own + 0.35 * ranking_score) / 0.75 AS s FROM dec JOIN cen USING (candidate) JOIN pd USING (candidate) WHERE status <> 'rejected')"""


@query(_recursive("SELECT row_number() OVER (ORDER BY s DESC, candidate)::INTEGER AS rank, candidate, family, round(s, 8) AS raw_composite_score, round((s - (SELECT min(s) FROM sc)) / CASE WHEN (SELECT max(s) > min(s) FROM sc) THEN (SELECT max(s) - min(s) FROM sc) ELSE 1 END, 8) AS composite_score FROM sc ORDER BY s DESC, candidate LIMIT 30", _RANKED))
def composite_score_rank(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best links and declines that the gate did not reject; composite_score_rank_all has all families."""
    return _ranked(*_decisions(spark, d, False))


@query()
def composite_score_rank_all(spark: SparkSession, d: str) -> DataFrame:
    """The 30 best candidates that the gate did not reject."""
    return _ranked(*_decisions(spark, d))


_ALL = """, cand AS (SELECT 'missing_link | ' || head || ' | ' || tail AS candidate, 'missing_link' AS family, least(abs(prediction_score) / 10, 1) AS p, NULL::DOUBLE AS dk, unnest([head, tail]) AS node FROM links
  UNION ALL SELECT 'temporal_decay | ' || node, 'temporal_decay', NULL, 1 - recent / earlier, node FROM decay WHERE earlier > 0 AND 1 - recent / earlier >= 0.3),
dc AS (SELECT node, count(*) / (SELECT count(DISTINCT node) - 1 FROM ends) AS c FROM (SELECT unnest([u, v]) AS node FROM (SELECT DISTINCT u, v FROM e)) GROUP BY node),
met AS (SELECT candidate, family, p, dk, avg(coalesce(c, 0)) AS c FROM cand LEFT JOIN dc ON dc.node = cand.node GROUP BY 1, 2, 3, 4),
raw AS (SELECT candidate, family, (0.15 * c + coalesce(0.25 * p, 0) + coalesce(0.25 * dk, 0)) / (0.15 + 0.25) AS s FROM met)"""


def _unvalidated(spark: SparkSession, d: str, clusters: bool) -> DataFrame:
    scratch = Scratch(spark, "score")
    e, c = _detected(spark, d, scratch, clusters)
    c = c.join(candidates.mean_centrality(c, graph.degree_centrality(e)), "candidate", "left")
    return c.withColumn("ranking_score", F.lit(None).cast("double"))


@query(sql("SELECT candidate, family, round(s, 8) AS raw_composite_score, round((s - (SELECT min(s) FROM raw)) / CASE WHEN (SELECT max(s) FROM raw) > (SELECT min(s) FROM raw) THEN (SELECT max(s) - min(s) FROM raw) ELSE 1 END, 8) AS composite_score FROM raw", _ALL))
def composite_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all unvalidated link and decay candidates, scaled among themselves; composite_scores_all has all families."""
    return _scores(_unvalidated(spark, d, False))


@query()
def composite_scores_all(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all unvalidated candidates, scaled over all three families."""
    return _scores(_unvalidated(spark, d, True))


def _scores(c: DataFrame) -> DataFrame:
    x = score.metric_columns(c).withColumn("raw_composite_score", score.composite())
    x = score.min_max(x, "raw_composite_score", "composite_score")
    return x.select("candidate", "family", F.round("raw_composite_score", 8).alias("raw_composite_score"), F.round("composite_score", 8).alias("composite_score"))


@query(
    sql(
        """SELECT unnest(['TransE only', 'Louvain only', 'Temporal decay only', 'TransE + Louvain', 'TransE + Decay', 'Louvain + Decay', 'All three (full)']) AS configuration,
  unnest([ml, 0, td, ml, ml + td, td, ml + td]) AS gaps FROM (SELECT count(*) FILTER (WHERE family = 'missing_link') AS ml, count(*) FILTER (WHERE family = 'temporal_decay') AS td FROM raw)""",
        _ALL,
    )
)
def ablation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links and decays only: without communities, which SQL cannot find, the rows with Louvain lack the clusters; ablation_counts_all has them."""
    return score.ablation(_unvalidated(spark, d, False))


@query()
def ablation_counts_all(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates every combination of the three families has."""
    return score.ablation(_unvalidated(spark, d, True))


@query()
def gate_ablation(spark: SparkSession, d: str) -> DataFrame:
    """How many candidates each reduced contract would let through."""
    x = evaluation.ablation_predictions(_decisions(spark, d)[1])
    row = x.agg(*[F.sum(c).alias(c) for c in evaluation.CONTRACTS])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("contract"), F.coalesce(F.col(c), F.lit(0)).alias("passed")) for c in evaluation.CONTRACTS])).alias("x")).select("x.*")
