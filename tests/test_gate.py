import pytest
from pyspark.sql import functions as F

from lacuna.operators import candidates, evaluation, gate, provenance, score, stability

EDGES = "edge_seq bigint, u string, v string, relation string, source_paper string, year int, evidence string, u_name string, v_name string, u_type string, v_type string"
A, B = "zero trust identity proxy", "adaptive token vault rotation"


def edges(spark, rows):
    return spark.createDataFrame([(i, u, v, "USES", p, y, ev, u, v, "METHOD", "TOOL") for i, (u, v, p, y, ev) in enumerate(rows)], EDGES)


BRIDGE = [(A, "bridge one", "p1", 2022, ""), ("bridge one", B, "p3", 2023, ""), (A, "bridge two", "p2", 2022, ""), ("bridge two", B, "p4", 2024, "")]


def link(spark, head=A, tail=B):
    x = spark.createDataFrame([(head, "RELATED_TO", tail, 5.0, 2)], "head string, relation string, tail string, prediction_score double, common_neighbors bigint")
    return candidates.table(x, None, None, None)


def docs(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc string, year int, text string")


def decide(spark, rows, cand=None, corpus=(), searched=True):
    d = None if corpus is None else docs(spark, corpus)
    return gate.decide(candidates.facts(edges(spark, rows), link(spark) if cand is None else cand, d, searched=searched)).first()


def test_supported_candidate_is_eligible(spark):
    r = decide(spark, BRIDGE)
    assert r["status"] == "automatically_eligible" and r["paths"] == 2 and r["papers"] == 4 and r["s_add"] == 1.0


def test_missing_search_asks_for_review(spark):
    r = decide(spark, BRIDGE, searched=False)
    assert r["status"] == "review_required" and r["s_add"] is None and r["reasons"] == ["plausible_edge_stress_unavailable"]


def test_plausible_direct_edge_lowers_stability(spark):
    rows = [*BRIDGE, (A, "other", "p8", 2024, f"works like {B} does")]
    r = decide(spark, rows)
    assert r["s_add"] < 1.0


def test_existing_edge_asks_for_review(spark):
    r = decide(spark, [*BRIDGE, (A, B, "p5", 2024, "")])
    assert r["existing_edge"] and "observed_relation_requires_qualified_review" in r["reasons"] and "unstable_under_multi_mode_perturbation" not in r["reasons"]


def test_single_and_dependent_paths_are_rejected(spark):
    r = decide(spark, BRIDGE[:2])
    assert r["status"] == "rejected" and r["paths"] == 1
    shared = [(A, "bridge one", "p", 2022, ""), ("bridge one", B, "p", 2023, ""), (A, "x", "u1", 2022, ""), (B, "y", "u2", 2022, "")]
    r = decide(spark, shared)
    assert r["status"] == "rejected" and r["papers"] == 1


def test_corpus_coverage_and_missing_corpus(spark):
    r = decide(spark, BRIDGE, corpus=[("d1", 2024, f"on {A} and {B}")])
    assert r["status"] == "review_required" and r["closure_hits"] == 1
    r = decide(spark, BRIDGE, corpus=None)
    assert "source_closure_corpus_unavailable" in r["reasons"] and r["m_closure_clearance"] == 0.0


def test_generic_entities_and_self_links_are_rejected(spark):
    rows = [(u.replace(A, "our method"), v, p, y, ev) for u, v, p, y, ev in BRIDGE]
    r = decide(spark, rows, link(spark, "our method", B))
    assert r["status"] == "rejected" and "generic_or_underspecified_entities" in r["reasons"]
    r = decide(spark, BRIDGE, link(spark, A, A))
    assert "canonical_self_link" in r["reasons"] and r["status"] == "rejected"


def test_closure_rules(spark):
    e = spark.createDataFrame([("c", "missing_link", 0, "JWT", None), ("c", "missing_link", 1, "OAuth", None), ("t", "temporal_decay", 0, "service mesh", 2022), ("a", "missing_link", 0, "nothing here", None), ("a", "missing_link", 0, "jwt", None), ("a", "missing_link", 1, "oauth", None)], "candidate string, family string, entity_no int, label string, peak_year int")
    d = docs(spark, [("1", 2020, "oauth2 and jwt"), ("2", 2021, "a service mesh"), ("3", 2024, "the service mesh again"), ("4", None, "service mesh")])
    assert sorted(tuple(r) for r in gate.closure_hits(e, d).collect()) == [("a", "1", 2020), ("c", "1", 2020), ("t", "3", 2024)]


def test_dropout_extremes_and_order(spark):
    e = edges(spark, BRIDGE)
    from lacuna.operators import paths

    p = paths.independent_paths(e, link(spark))
    one = lambda keep, **k: stability.link_survival(paths.path_edges(p), "edge", keep, **k).first()["survival"]
    assert one(1.0) == 1.0 and one(-1.0) == 0.0 and 0 < one(0.5) < 1 and one(0.5) == one(0.5)
    assert one(0.5, min_paths=2) <= one(0.5)
    assert stability.link_survival(paths.path_papers(p, paths.edge_papers(e)), "paper", 1.0).first()["survival"] == 1.0


def test_cluster_stability(spark):
    names = [f"k{i}" for i in range(5)]
    rows = [(a, b, f"p{i}{j}", 2022, "") for i, a in enumerate(names) for j, b in enumerate(names) if i < j] + [("k0", "far", "q", 2022, "")]
    e = edges(spark, rows)
    from lacuna.operators import graph, paths

    m = spark.createDataFrame([(n, "k") for n in names], "node string, community string")
    at = stability.cluster_edges(graph.simple(e), m)
    assert at.where("inside").count() == 10 and at.where("not inside").count() == 1
    assert stability.cluster_survival(at, "edge", 1.0).first()["survival"] == 1.0 and stability.cluster_survival(at, "paper", -1.0, sources=paths.edge_papers(e)).first()["survival"] == 1.0
    extra = spark.createDataFrame([("k", i) for i in range(6)], "community string, item bigint")
    assert stability.cluster_addition_survival(at, extra).first()["survival"] < 0.5
    assert stability.cluster_addition_survival(at, extra.limit(0)).first()["survival"] == 1.0
    assert gate.internal_papers(e, m).first()["papers"] == 10


def test_decay_stability(spark):
    rows = [("c", f"x{y}{i}", f"p{y}{i}", y, "") for y in (2020, 2021) for i in range(4)] + [("c", "z", None, 2023, "")]
    e = edges(spark, rows)
    ev = stability.incident(e, spark.createDataFrame([("c",)], "concept string"))
    pubs = spark.createDataFrame([(y, 10) for y in range(2019, 2025)], "year int, publications bigint")
    d = stability.gate_decay(ev, pubs, 2023).first()
    assert d["active_years"] == 3 and abs(d["decay"] - (1 - 0.1 / 0.8)) < 1e-9
    assert stability.decay_survival(ev, pubs, "edge", 2023, 1.0).first()["survival"] == 1.0
    assert stability.decay_survival(ev, pubs, "edge", 2023, -1.0).first()["survival"] == 0.0


def test_plausible_edges_by_family(spark):
    c = spark.createDataFrame([("l", "missing_link", "a", "b", None, None), ("o", "orphan_cluster", None, None, None, ["a", "b"]), ("t", "temporal_decay", None, None, "c", None)], "candidate string, family string, head string, tail string, concept string, members array<string>")
    pool = [("a", "b"), ("b", "a"), ("a", "c"), (" ", "a"), ("a", "a"), (None, "b")]
    p = spark.createDataFrame([(k, str(i), h, t, None, None) for k in "lot" for i, (h, t) in enumerate(pool)], "candidate string, item string, head string, tail string, paper string, year int")
    got = sorted((r["candidate"], r["item"]) for r in candidates.relevant_plausible(c, p).collect())
    assert got == [("l", "0"), ("l", "1"), ("o", "2"), ("t", "2")]


def test_listed_hits_are_the_newest(spark):
    hits = spark.createDataFrame([("c", f"d{i:02}", 2000 + i if i else None) for i in range(13)] + [("e", "x", None)], "candidate string, doc string, year int")
    got = gate.listed_hits(hits).collect()
    assert sorted(r["doc"] for r in got if r["candidate"] == "c") == [f"d{i:02}" for i in range(3, 13)] and {(r["candidate"], r["n"]) for r in got} == {("c", 13), ("e", 1)}


def test_scores(spark):
    df = spark.createDataFrame([("a", "missing_link", 20.0, None, None, 0.2, None), ("b", "orphan_cluster", None, 0.1, None, 0.2, 0.5), ("c", "temporal_decay", None, None, 0.5, None, None)], "candidate string, family string, prediction_score double, inter_edge_ratio double, decay_rate double, mean_centrality double, ranking_score double")
    got = {r["candidate"]: r for r in score.rank_candidates(df, tie="candidate").collect()}
    assert abs(got["a"]["raw_composite_score"] - (0.15 * 0.2 + 0.25) / 0.4) < 1e-12
    assert abs(got["b"]["raw_composite_score"] - (0.15 * 0.2 + 0.25 * 0.9 + 0.35 * 0.5) / 0.75) < 1e-12
    assert got["a"]["rank"] == 1 and got["a"]["composite_score"] == 1.0 and got["c"]["composite_score"] == 0.0
    same = score.rank_candidates(df.where("candidate = 'a'"), tie="candidate").first()
    assert same["composite_score"] == 0.0
    assert {r["configuration"]: r["gaps"] for r in score.ablation(df).collect()}["All three (full)"] == 3


def test_evaluation(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 1), (0, 1, 0.8, 2), (1, 0, 0.7, 3), (0, 0, 0.7, 4)], "label int, prediction int, score double, seq int")
    c = evaluation.confusion(df).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"], c["f1"]) == (1, 1, 1, 1, 0.5)
    r = evaluation.ranking(df.withColumn("g", F.lit(1)), ["g"], 2).first()
    assert r["precision_at_k"] == 0.5 and r["recall_at_k"] == 0.5 and abs(r["average_precision"] - (1 + 2 / 3) / 2) < 1e-12
    none = evaluation.confusion(df.where("label = 0 and prediction = 0")).first()
    assert none["precision"] == 0 and none["f1"] == 0
    m = evaluation.mean_f1(spark.createDataFrame([(0.8,), (0.9,)], "f1 double")).first()
    assert m["low"] <= m["mean_f1"] <= m["high"] <= 1
    rev = spark.createDataFrame([("a", "Accept"), ("b", None), ("c", "Reject")], "review_key string, decision string")
    s = evaluation.review_summary(rev).first()
    assert s["acceptance_rate"] == 0.5 and not s["complete"] and s["pending"] == 1
    dec = spark.createDataFrame([("a", "rejected", 1), ("z", "review_required", 2)], "review_key string, status string, seq int")
    t = {r["status"]: (r["accept"], r["pending"]) for r in evaluation.crosstab(dec, rev, "review_key").collect()}
    assert t == {"rejected": (1, 0), "review_required": (0, 1), "automatically_eligible": (0, 0)}
    assert [r["position"] for r in evaluation.queue_positions(dec).orderBy("seq").collect()] == [2, 1]
    assert {r["review_key"]: r["decision"] for r in evaluation.carry_reviews(dec, rev, "review_key").collect()} == {"a": "Accept", "z": "Pending"}
    assert evaluation.best_setting(spark.createDataFrame([(1.0, 0.9, 1.0, 100), (1.0, 0.9, 1.0, 50)], "f1 double, precision double, recall double, repeats int")).first()["repeats"] == 50


@pytest.fixture(scope="module")
def trio(spark):
    return edges(spark, [("A", "Bridge", "p1", 2020, "e"), ("Bridge", "B", "p2", 2021, "e"), ("Bridge", "B", "p2", 2021, "e"), ("c1", "c2", "p3", 2020, ""), ("c1", "out", "px", 2020, ""), ("time", "c1", "p4", 2022, "")])


def test_provenance(spark, trio):
    nodes = spark.createDataFrame([("link", ["A", "Bridge", "B"])], "candidate string, nodes array<string>")
    papers = spark.createDataFrame([(1, "p1", "Title", [("Ann",), (None,)], 2020, None, 3, None, {"DOI": "10.1/x"})], "seq bigint, paperId string, title string, authors array<struct<name:string>>, year int, venue string, citationCount int, url string, externalIds map<string,string>")
    rec = provenance.path_records(trio, nodes)
    got = {r["paper_id"]: (r["title"], r["evidence_records"]) for r in provenance.resolve(rec, papers).collect()}
    assert got == {"p1": ("Title", 1), "p2": ("Paper p2", 1)}
    more = provenance.resolve(rec, papers, spark.createDataFrame([("link", "p9")], "candidate string, paper_id string"))
    assert more.count() == 3
    inside = provenance.cluster_records(trio, spark.createDataFrame([("k", "c1"), ("k", "c2")], "candidate string, node string"))
    assert [r["paper_id"] for r in inside.collect()] == ["p3"]
    at = provenance.concept_records(trio, spark.createDataFrame([("t", "time")], "candidate string, concept string"))
    assert [r["paper_id"] for r in at.collect()] == ["p4"]
    inv = provenance.inversion(provenance.resolve(rec, papers), spark.createDataFrame([("link", "missing_link")], "candidate string, family string"))
    assert {r["paper_id"]: r["candidates"] for r in inv.collect()} == {"p1": 1, "p2": 1}
    card = provenance.paper_cards(papers).first()
    assert card["authors"] == ["Ann"] and card["doi"] == "10.1/x"
