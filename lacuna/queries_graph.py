"""Graph queries over the whole triples table, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.catalog import query
from lacuna.operators import candidates, detect, embedding, graph, paths, provenance, reports, resolve
from lacuna.plans.runtime import Scratch, table

SNAPSHOT = "2026-04-30"

_names = lambda xs: ", ".join(f"'{x}'" for x in xs)
_key = lambda c: f"lower(trim(regexp_replace({c}, '[ \\t\\r\\n]+', ' ', 'g')))"

#: The edges of the graph as a chain of named subqueries.
EDGES_SQL = f"""e0 AS (
  SELECT seq AS edge_seq, {_key("subject.name")} AS u, {_key("object.name")} AS v, relation, coalesce(confidence, 0.5) AS confidence,
    nullif(source_paper_id, '') AS source_paper, try_cast(regexp_extract(source_year, '^\\s*([+-]?[0-9]+)\\s*$', 1) AS INTEGER) AS year,
    evidence, subject.type AS u_type, object.type AS v_type
  FROM triples WHERE subject.name IS NOT NULL AND object.name IS NOT NULL),
e AS (
  SELECT * FROM e0 WHERE confidence >= 0.3 AND relation IN ({_names(graph.RELATIONS)}) AND u <> '' AND v <> '' AND u <> v
    AND u NOT IN ({_names(graph.BAD_ENTITIES)}) AND v NOT IN ({_names(graph.BAD_ENTITIES)})),
ends AS (SELECT edge_seq, u AS node, u_type AS type, 0 AS role, source_paper, year FROM e UNION ALL SELECT edge_seq, v, v_type, 1, source_paper, year FROM e),
simple AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM e),
adj AS (SELECT a AS node, b AS other FROM simple UNION ALL SELECT b, a FROM simple),
deg AS (SELECT node, count(*) AS degree FROM adj GROUP BY node),
hops AS (
  SELECT x.other AS head, y.other AS tail, count(*) AS n FROM adj x JOIN adj y ON x.node = y.node AND x.other < y.other
  WHERE NOT EXISTS (SELECT 1 FROM simple s WHERE s.a = x.other AND s.b = y.other) GROUP BY 1, 2),
links AS (
  SELECT head, 'RELATED_TO' AS relation, tail, 10.0::DOUBLE * (n / sqrt((d.degree * t.degree)::DOUBLE)) AS prediction_score, n AS common_neighbors
  FROM hops JOIN deg d ON d.node = head JOIN deg t ON t.node = tail
  ORDER BY prediction_score DESC, common_neighbors DESC, head DESC, tail DESC LIMIT 50),
bounds AS (
  SELECT min(year) AS min_year, max(year) AS observed_max_year, CASE WHEN max(year) = {SNAPSHOT[:4]} THEN max(year) - 1 ELSE max(year) END AS max_year FROM e),
pubs AS (SELECT year, count(DISTINCT source_paper) AS publications FROM e WHERE year IS NOT NULL AND source_paper IS NOT NULL GROUP BY year),
activity AS (
  SELECT node, year, count(DISTINCT paper) AS papers FROM (
    SELECT unnest([u, v]) AS node, year, coalesce(source_paper, concat_ws('-', 'event', u, v, year::VARCHAR)) AS paper FROM e WHERE year IS NOT NULL)
  GROUP BY node, year),
rates AS (
  SELECT node, a.year, papers, papers / greatest(coalesce(publications, 0), 1) AS rate, max_year
  FROM activity a CROSS JOIN bounds LEFT JOIN pubs p ON p.year = a.year WHERE a.year <= max_year),
decay AS (
  SELECT node, sum(CASE WHEN max_year - year < 2 THEN rate ELSE 0 END) / 2 AS recent, sum(CASE WHEN max_year - year BETWEEN 2 AND 3 THEN rate ELSE 0 END) / 2 AS earlier,
    sum(papers)::BIGINT AS total, arg_max(year, (rate, -year)) AS peak_year, arg_max(papers, (rate, -year)) AS peak_activity, max(max_year) AS analysis_end_year
  FROM rates GROUP BY node HAVING sum(papers) >= 3)"""

_decay = """SELECT node AS concept, round(CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END, 6) AS decay_rate, peak_year, peak_activity,
  round(recent, 9) AS recent_activity, round(earlier, 9) AS earlier_activity, total AS total_activity, analysis_end_year
FROM decay WHERE CASE WHEN earlier > 0 THEN 1 - recent / earlier ELSE 0 END >= 0.3"""


def sql(body: str, first: str = "") -> str:
    return f"WITH {EDGES_SQL}{first}\n{body}"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_from_triples(table(spark, d, "triples"), key=graph.plain_key)


@query(sql(_decay))
def temporal_decay(spark: SparkSession, d: str) -> DataFrame:
    x = detect.by_decay(detect.temporal_decay(edges(spark, d), snapshot_date=SNAPSHOT))
    return x.withColumns({"decay_rate": F.round("decay_rate", 6), "recent_activity": F.round("recent_activity", 9), "earlier_activity": F.round("earlier_activity", 9)})


@query(sql("SELECT node, year, papers FROM activity"))
def node_year_activity(spark: SparkSession, d: str) -> DataFrame:
    return detect.node_year_papers(edges(spark, d))


@query(sql("SELECT year, publications FROM pubs"))
def publication_counts(spark: SparkSession, d: str) -> DataFrame:
    return detect.papers_per_year(edges(spark, d))


@query(sql("SELECT min_year, observed_max_year, max_year FROM bounds"))
def right_censor(spark: SparkSession, d: str) -> DataFrame:
    return detect.year_bounds(edges(spark, d), SNAPSHOT)


@query(
    sql("""SELECT n.node, y.year, coalesce(a.papers, 0) AS papers, round(coalesce(a.papers, 0) / greatest(coalesce(p.publications, 0), 1), 9) AS rate
FROM (SELECT DISTINCT node FROM activity) n CROSS JOIN (SELECT unnest(range(min_year, max_year + 1))::INTEGER AS year FROM bounds) y
LEFT JOIN activity a ON a.node = n.node AND a.year = y.year LEFT JOIN pubs p ON p.year = y.year""")
)
def temporal_profiles(spark: SparkSession, d: str) -> DataFrame:
    return detect.temporal_profiles(edges(spark, d), SNAPSHOT).withColumn("rate", F.round("rate", 9))


@query(sql("SELECT head, relation, tail, round(prediction_score, 9) AS prediction_score, common_neighbors FROM links"))
def common_neighbor_links(spark: SparkSession, d: str) -> DataFrame:
    return detect.common_neighbor_links(graph.simple(edges(spark, d))).withColumn("prediction_score", F.round("prediction_score", 9))


@query(sql("SELECT head, 'RELATED_TO' AS relation, tail, n::DOUBLE AS prediction_score, n AS common_neighbors FROM hops ORDER BY n DESC, head, tail LIMIT 50"))
def structural_missing_links(spark: SparkSession, d: str) -> DataFrame:
    return detect.structural_missing_links(graph.simple(edges(spark, d)))


@query(
    sql("""SELECT node, count(*) AS degree, round(count(*) / (SELECT count(DISTINCT node) - 1 FROM ends), 9) AS centrality
FROM (SELECT unnest([u, v]) AS node FROM (SELECT DISTINCT u, v FROM e)) GROUP BY node""")
)
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_centrality(edges(spark, d)).withColumn("centrality", F.round("centrality", 9))


@query(sql("SELECT degree, count(*) AS nodes FROM deg GROUP BY degree"))
def degree_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.simple(edges(spark, d))).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(
    sql("""SELECT (SELECT count(DISTINCT node) FROM ends) AS nodes, count(*) AS edges, count(DISTINCT (u, v)) AS simple_edges, count(DISTINCT source_paper) AS papers, min(year) AS min_year,
  max(year) AS max_year, round(count(*)::DOUBLE / ((SELECT count(DISTINCT node) FROM ends) * ((SELECT count(DISTINCT node) FROM ends) - 1)), 9) AS density FROM e""")
)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_stats(edges(spark, d)).withColumn("density", F.round("density", 9))


@query(sql("SELECT node, coalesce(arg_min_null(type, edge_seq * 2 + role), 'UNKNOWN') AS type, count(*) AS occurrences, count(DISTINCT source_paper) AS papers FROM ends GROUP BY node"))
def entity_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.entity_index(edges(spark, d)).drop("label")


@query(sql("SELECT relation, count(*) AS n FROM e GROUP BY relation"))
def relation_distribution(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).groupBy("relation").agg(F.count("*").alias("n"))


@query(sql("SELECT upper(coalesce(type, 'UNKNOWN')) AS type, count(*) AS n, count(DISTINCT node) AS nodes FROM ends GROUP BY 1"))
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.endpoints(edges(spark, d)).groupBy(F.upper(F.coalesce("type", F.lit("UNKNOWN"))).alias("type")).agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes"))


@query(
    sql("SELECT node, component FROM w", """,
w(node, component) USING KEY (node) AS (SELECT node, node FROM deg UNION SELECT a.other, min(w.component) FROM w JOIN adj a ON a.node = w.node JOIN recurring.w AS r ON r.node = a.other WHERE w.component < r.component GROUP BY a.other)""").replace("WITH e0", "WITH RECURSIVE e0")
)
def weak_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.weak_components(graph.simple(edges(spark, d)))


@query(
    sql(
        """SELECT c.community, c.size, round(c.size / (SELECT count(*) FROM m), 9) AS size_ratio, coalesce(x.intra, 0) AS intra_edges, coalesce(x.inter, 0) AS inter_edges,
  round(coalesce(x.inter, 0) / greatest(coalesce(x.inter, 0) + coalesce(x.intra, 0), 1), 9) AS inter_edge_ratio
FROM (SELECT community, count(*) AS size FROM m GROUP BY community) c LEFT JOIN (
  SELECT community, count(*) FILTER (WHERE inside) AS intra, count(*) FILTER (WHERE NOT inside) AS inter FROM (
    SELECT unnest(list_distinct([p.community, q.community])) AS community, p.community = q.community AS inside FROM simple s JOIN m p ON p.node = s.a JOIN m q ON q.node = s.b)
  GROUP BY community) x ON x.community = c.community""",
        ",\nm AS (SELECT node, upper(coalesce(arg_min_null(type, edge_seq * 2 + role), 'UNKNOWN')) AS community FROM ends GROUP BY node)",
    )
)
def type_isolation(spark: SparkSession, d: str) -> DataFrame:
    """How isolated the nodes of each type are, as communities."""
    e = edges(spark, d)
    m = graph.entity_index(e).select("node", F.upper("type").alias("community"))
    return detect.cluster_stats(graph.simple(e), m).withColumns({"size_ratio": F.round("size_ratio", 9), "inter_edge_ratio": F.round("inter_edge_ratio", 9)})


def community_membership(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = Scratch(spark, "simple").save(graph.simple(edges(spark, d)), "pairs")
    return pairs, detect.communities(pairs)


@query()
def orphan_clusters(spark: SparkSession, d: str) -> DataFrame:
    return detect.orphan_clusters(*community_membership(spark, d))


@query()
def community_modularity(spark: SparkSession, d: str) -> DataFrame:
    return detect.modularity(*community_membership(spark, d))


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """Exact betweenness of every entity of the triples' graph."""
    return graph.betweenness(edges(spark, d))


def _candidates(spark: SparkSession, d: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    e = scratch.save(edges(spark, d), "edges")
    return e, scratch.save(detect.common_neighbor_links(graph.simple(e)), "links")


#: All simple paths of two to four edges between the ends of the top candidates.
_PATHS = """,
walks AS (
  SELECT l.head, l.tail, [l.head, x.other, l.tail] AS nodes FROM links l JOIN adj x ON x.node = l.head JOIN adj y ON y.node = x.other AND y.other = l.tail
  UNION ALL
  SELECT l.head, l.tail, [l.head, x.other, z.other, l.tail] FROM links l JOIN adj x ON x.node = l.head JOIN adj y ON y.node = l.tail
    JOIN adj z ON z.node = x.other AND z.other = y.other WHERE x.other <> l.tail AND y.other <> l.head
  UNION ALL
  SELECT p.head, p.tail, [p.head, p.a, p.m, q.b, p.tail] FROM (
    SELECT l.head, l.tail, x.other AS a, y.other AS m FROM links l JOIN adj x ON x.node = l.head JOIN adj y ON y.node = x.other WHERE x.other <> l.tail AND y.other NOT IN (l.head, l.tail)) p JOIN (
    SELECT l.head, l.tail, x.other AS b, y.other AS m FROM links l JOIN adj x ON x.node = l.tail JOIN adj y ON y.node = x.other WHERE x.other <> l.head AND y.other NOT IN (l.head, l.tail)) q
    ON q.head = p.head AND q.tail = p.tail AND q.m = p.m AND q.b <> p.a)"""


@query(sql("SELECT head, tail, array_to_string(nodes, ' > ') AS path, len(nodes) - 1 AS hops FROM walks", _PATHS))
def evidence_paths(spark: SparkSession, d: str) -> DataFrame:
    """All simple paths of up to four edges between the ends of the top candidates."""
    e, c = _candidates(spark, d, Scratch(spark, "paths"))
    return paths.simple_paths(graph.simple(e), c).select("head", "tail", F.array_join("nodes", " > ").alias("path"), (F.size("nodes") - 1).cast("bigint").alias("hops"))


#: The paths whose every edge has a paper, walked one by one in the greedy order.
GREEDY_SQL = _PATHS + """,
src AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b, source_paper AS paper FROM e WHERE source_paper IS NOT NULL),
hop AS (SELECT head, tail, nodes, unnest(range(1, len(nodes))) AS i FROM walks),
item AS (SELECT head, tail, nodes, i, least(nodes[i], nodes[i + 1]) AS a, greatest(nodes[i], nodes[i + 1]) AS b, paper FROM hop LEFT JOIN src ON src.a = least(nodes[i], nodes[i + 1]) AND src.b = greatest(nodes[i], nodes[i + 1])),
tr AS (SELECT head, tail, nodes, list(DISTINCT 'edge~' || a || '~' || b) || list(DISTINCT 'paper~' || paper) FILTER (WHERE paper IS NOT NULL) AS items FROM item GROUP BY 1, 2, 3 HAVING count(*) FILTER (WHERE paper IS NULL) = 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY len(nodes), nodes) AS r FROM tr),
chosen AS (
  SELECT head, tail, 0::BIGINT AS r, []::VARCHAR[] AS held, 0::BIGINT AS path_no, NULL::VARCHAR[] AS nodes FROM (SELECT DISTINCT head, tail FROM rk)
  UNION ALL
  SELECT c.head, c.tail, k.r, CASE WHEN list_has_any(c.held, k.items) THEN c.held ELSE c.held || k.items END, CASE WHEN list_has_any(c.held, k.items) THEN c.path_no ELSE c.path_no + 1 END, CASE WHEN list_has_any(c.held, k.items) THEN NULL ELSE k.nodes END
  FROM chosen c JOIN rk k ON k.head = c.head AND k.tail = c.tail AND k.r = c.r + 1),
ind AS (SELECT c.head, c.tail, path_no::INTEGER AS path_no, c.nodes, items FROM chosen c JOIN rk ON rk.head = c.head AND rk.tail = c.tail AND rk.r = c.r WHERE c.nodes IS NOT NULL)"""


@query(sql("SELECT head, tail, path_no, array_to_string(nodes, ' > ') AS path, len(list_filter(items, lambda x: starts_with(x, 'paper~')))::BIGINT AS papers FROM ind", GREEDY_SQL).replace("WITH e0", "WITH RECURSIVE e0"))
def independent_paths(spark: SparkSession, d: str) -> DataFrame:
    """Independent evidence paths of up to four edges between the ends of the top candidates."""
    scratch = Scratch(spark, "paths")
    e, c = _candidates(spark, d, scratch)
    sources = scratch.save(paths.edge_papers(e), "sources")
    p = scratch.save(paths.independent_paths(e, c, 4, sources), "independent")
    n = paths.path_papers(p, sources).groupBy("head", "tail", "path_no").agg(F.count("*").alias("papers"))
    return p.join(n, ["head", "tail", "path_no"]).select("head", "tail", "path_no", F.array_join("nodes", " > ").alias("path"), "papers")


#: Up to three independent paths of each candidate, or else its three shortest.
_RECORDS = GREEDY_SQL + """,
few AS (SELECT head, tail, nodes FROM ind WHERE path_no <= 3 UNION ALL SELECT head, tail, nodes FROM (SELECT *, row_number() OVER (PARTITION BY head, tail ORDER BY len(nodes), nodes) AS r FROM walks) WHERE r <= 3 AND (head, tail) NOT IN (SELECT (head, tail) FROM ind)),
step AS (SELECT head, tail, nodes, unnest(range(1, len(nodes))) AS i FROM few),
way AS (SELECT DISTINCT head || ' | ' || tail AS candidate, (least(nodes[i], nodes[i + 1]), greatest(nodes[i], nodes[i + 1])) AS h FROM step),
rec AS (SELECT DISTINCT candidate, u, relation, v, source_paper AS paper_id, coalesce(evidence, '') AS evidence FROM way JOIN e ON (least(u, v), greatest(u, v)) = h),
card AS (SELECT paperId AS paper_id, arg_min_null(nullif(title, ''), seq) AS title, arg_min_null(year, seq) AS paper_year, coalesce(arg_min_null(venue, seq), '') AS venue FROM papers WHERE nullif(paperId, '') IS NOT NULL GROUP BY 1),
res AS (SELECT candidate, r.paper_id, coalesce(title, 'Paper ' || r.paper_id) AS title, paper_year, coalesce(venue, '') AS venue, count(*) AS evidence_records
  FROM rec r LEFT JOIN card c ON c.paper_id = r.paper_id WHERE r.paper_id IS NOT NULL GROUP BY 1, 2, 3, 4, 5)"""


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "provenance")
    e, c = _candidates(spark, d, scratch)
    few = paths.evidence(e, c, 4, 3).select(F.concat_ws(" | ", "head", "tail").alias("candidate"), "nodes")
    return provenance.resolve(provenance.path_records(e, few), table(spark, d, "papers"))


@query(sql("SELECT candidate, paper_id, title, paper_year, venue, evidence_records FROM res", _RECORDS).replace("WITH e0", "WITH RECURSIVE e0"))
def gap_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Papers and evidence behind the top link candidates, newest first: on up to three independent evidence paths of at most four edges, or else the shortest paths; gap_provenance_all has all families."""
    return provenance.listed(_provenance(spark, d))


@query(sql("SELECT paper_id, count(DISTINCT candidate) AS candidates, 'missing_link' AS families FROM res GROUP BY paper_id", _RECORDS).replace("WITH e0", "WITH RECURSIVE e0"))
def source_paper_inversion(spark: SparkSession, d: str) -> DataFrame:
    """The candidates that each paper of gap_provenance supports; source_paper_inversion_all has all families."""
    r = _provenance(spark, d)
    fam = r.select("candidate", F.lit("missing_link").alias("family")).distinct()
    return provenance.by_support(provenance.inversion(r, fam), table(spark, d, "papers")).withColumn("families", F.array_join("families", ","))


def _provenance_all(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(candidates of all families, their papers)."""
    scratch = Scratch(spark, "provenance")
    e = scratch.save(edges(spark, d), "edges")
    pairs, member = community_membership(spark, d)
    links = scratch.save(detect.common_neighbor_links(pairs), "links")
    c = scratch.save(candidates.table(links, detect.orphan_clusters(pairs, member), member, detect.temporal_decay(e, snapshot_date=SNAPSHOT)), "candidates")
    few = paths.shortest_paths(pairs, links, 4, 3).select(F.concat_ws(" | ", F.lit("missing_link"), "head", "tail").alias("candidate"), "nodes")
    r = provenance.path_records(e, few)
    r = r.unionByName(provenance.cluster_records(e, c.where("family = 'orphan_cluster'").select("candidate", F.explode("members").alias("node"))))
    r = r.unionByName(provenance.concept_records(e, c.where("family = 'temporal_decay'").select("candidate", "concept")))
    return c, provenance.resolve(r, table(spark, d, "papers"))


@query()
def gap_provenance_all(spark: SparkSession, d: str) -> DataFrame:
    """Papers and evidence behind the candidates of all families: on up to three shortest paths of at most four edges, inside clusters, at concepts; newest papers first."""
    return provenance.listed(_provenance_all(spark, d)[1])


@query()
def source_paper_inversion_all(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of all families that each paper supports."""
    c, r = _provenance_all(spark, d)
    return provenance.by_support(provenance.inversion(r, c.select("candidate", "family")), table(spark, d, "papers")).withColumn("families", F.array_join("families", ","))


@query()
def fuzzy_merge(spark: SparkSession, d: str) -> DataFrame:
    """Greedy merging of all entity names of the graph by token-sorted similarity."""
    names = graph.endpoints(edges(spark, d)).groupBy(F.col("node").alias("name")).agg(F.count("*").alias("occurrences"), F.min("edge_seq").alias("seq"))
    names = Scratch(spark, "names").save(names, "names")
    return resolve.greedy_merge(names, resolve.fuzzy_pairs(names.select("name"), 85))


@query()
def embedding_links(spark: SparkSession, d: str) -> DataFrame:
    """Unobserved statements over the 5,000 directed pairs with most common neighbours, by translation embeddings of the reference's size."""
    e = Scratch(spark, "embedding").save(edges(spark, d), "edges")
    return embedding.links(e, Scratch(spark, "pairs").save(detect.embedding_pairs(e), "pairs"), 50, dim=128, epochs=100)


@query(
    sql("""SELECT bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, count(*) AS n
FROM (SELECT least(floor((degree - lo) / w), 29)::INTEGER AS bin, lo, w FROM deg, (SELECT min(degree)::DOUBLE AS lo, (max(degree) - min(degree)) / 30.0::DOUBLE AS w FROM deg)) GROUP BY bin, lo, w""")
)
def degree_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = reports.histogram(graph.degrees(graph.simple(edges(spark, d))), "degree", 30)
    return h.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(sql("SELECT node, degree FROM deg ORDER BY degree DESC, node LIMIT 10"))
def top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return reports.top(graph.degrees(graph.simple(edges(spark, d))), "degree", 10, "node")
