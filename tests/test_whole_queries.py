"""Queries over the whole job, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lacuna import catalog, queries_gate, queries_graph
from lacuna.functions.text import tokens
from lacuna.operators import detect, graph
from lacuna.plans.runtime import Scratch


def rows(spark, d, name):
    return catalog.queries()[name](spark, d).collect()


@pytest.fixture(scope="module")
def families(spark, small):
    """(edges, candidates) of all three families, for communities that are quick to make: the nodes by their last two letters."""
    scratch = Scratch(spark, "test")
    pairs = scratch.save(graph.simple(queries_graph.edges(spark, small)), "pairs")
    member = scratch.save(graph.both_ways(pairs).select("node", F.substring("node", -2, 2).alias("community")).distinct(), "members")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(queries_gate, "community_membership", lambda spark, d: (pairs, member))
        e, c = queries_gate._detected(spark, small, scratch)
        yield e, c.cache()


def test_ablation_has_the_clusters(spark, small, families):
    by = Counter(r["family"] for r in families[1].collect())
    n = {"ml": by["missing_link"], "oc": by["orphan_cluster"], "td": by["temporal_decay"]}
    assert n["oc"] > 0
    got = {r["configuration"]: r["gaps"] for r in rows(spark, small, "ablation_counts_all")}
    assert got == {"TransE only": n["ml"], "Louvain only": n["oc"], "Temporal decay only": n["td"], "TransE + Louvain": n["ml"] + n["oc"], "TransE + Decay": n["ml"] + n["td"], "Louvain + Decay": n["oc"] + n["td"], "All three (full)": sum(n.values())}


def test_scores_have_the_clusters(spark, small, families):
    e, c = families
    directed = {(r["u"], r["v"]) for r in e.collect()}
    deg = Counter(x for uv in directed for x in uv)
    raw = {}
    for r in c.collect():
        nodes = r["members"] if r["family"] == "orphan_cluster" else r["entities"]
        metric = {"missing_link": lambda r: min(abs(r["prediction_score"]) / 10, 1), "orphan_cluster": lambda r: 1 - r["inter_edge_ratio"], "temporal_decay": lambda r: r["decay_rate"]}[r["family"]](r)
        raw[r["candidate"]] = (0.15 * sum(deg[x] / (len(deg) - 1) for x in nodes) / len(nodes) + 0.25 * metric) / 0.4
    low, high = min(raw.values()), max(raw.values())
    got = {r["candidate"]: r for r in rows(spark, small, "composite_scores_all")}
    assert set(got) == set(raw) and {r["family"] for r in got.values()} == {"missing_link", "orphan_cluster", "temporal_decay"}
    for k, v in raw.items():
        assert abs(got[k]["raw_composite_score"] - v) < 2e-8 and abs(got[k]["composite_score"] - (v - low) / (high - low)) < 2e-8


def test_closure_screens_the_clusters(spark, small, families):
    c = families[1].select("candidate", "family", "peak_year", F.transform(F.slice("entities", 1, 6), lambda x: F.array_distinct(tokens(x))).alias("sets")).collect()
    docs = queries_gate._docs(spark, small).select("year", F.array_distinct(tokens(F.col("text"))).alias("t")).collect()
    want = Counter()
    for r in c:
        sets = [set(t) for t in r["sets"] if t]
        for doc in docs:
            have = set(doc["t"])
            hit = sum(len(t & have) >= max(1, -int(-(len(t) * 0.6 - 1e-9) // 1)) for t in sets)
            if len(sets) >= 2 and hit >= 2 or r["family"] == "temporal_decay" and len(sets) == 1 == hit and doc["year"] is not None and doc["year"] > (r["peak_year"] or 0):
                want[r["candidate"]] += 1
    assert any(k.startswith("orphan_cluster") for k in want)
    assert {r["candidate"]: r["hits"] for r in rows(spark, small, "closure_hits_all")} == dict(want)


TRIPLES = "seq bigint, subject struct<name:string,type:string>, relation string, object struct<name:string,type:string>, confidence double, evidence string, source_paper_id string, source_year string"
PAPERS = "seq bigint, paperId string, title string, abstract string, authors array<struct<name:string>>, year int, venue string, citationCount int, url string, externalIds map<string,string>"


@pytest.fixture(scope="module")
def tiny(spark, tmp_path_factory):
    """(folder, statements) of a graph of 14 nodes."""
    d = str(tmp_path_factory.mktemp("tiny"))
    rng = random.Random(4)
    rows = [(i, *rng.sample([f"n{k:02}" for k in range(14)], 2), "USES", f"p{i % 17}", rng.choice([2018, 2019, 2020, 2021, 2022, 2023, 2024])) for i in range(30)]
    t = [(i, (u, "M"), r, (v, "M"), 0.9, f"e{i}", p, str(y)) for i, u, v, r, p, y in rows]
    spark.createDataFrame(t, TRIPLES).write.parquet(f"{d}/triples.parquet")
    papers = [(1, "p1", None, "graph search over paths", None, 2020, None, None, None, None), (2, "p2", "T", "graph search over trees", None, 2020, None, None, None, None), (3, "p3", "T", "unrelated words entirely", None, 2020, None, None, None, None), (20, "p4", None, "search paths", None, 2020, None, None, None, None)]
    spark.createDataFrame(papers, PAPERS).write.parquet(f"{d}/papers.parquet")
    return d, rows


def simple_walks(rows, a, b, most):
    near = {}
    for _, u, v, *_ in rows:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    out, todo = [], [[a]]
    while todo:
        w = todo.pop()
        if w[-1] == b:
            out.append(w)
        elif len(w) <= most:
            todo += [[*w, x] for x in near[w[-1]] - set(w)]
    return sorted(out, key=lambda w: (len(w), w))


def test_paths_and_provenance_of_all_families(spark, tiny, monkeypatch):
    d, data = tiny
    pairs = graph.simple(queries_graph.edges(spark, d))
    member = graph.both_ways(pairs).select("node", F.when(F.col("node") < "n04", "x").otherwise("y").alias("community")).distinct()
    monkeypatch.setattr(queries_graph, "community_membership", lambda spark, d: (pairs, member))
    monkeypatch.setattr(queries_graph.detect, "orphan_clusters", detect.cluster_stats)
    links = [(r["head"], r["tail"]) for r in rows(spark, d, "common_neighbor_links")]
    decays = [r["concept"] for r in rows(spark, d, "temporal_decay")]
    assert links and decays
    want_paths = {(a, b, " > ".join(w)) for a, b in links for w in simple_walks(data, a, b, 4)}
    assert {(r["head"], r["tail"], r["path"]) for r in rows(spark, d, "evidence_paths")} == want_paths and any(p.count(">") == 4 for *_, p in want_paths)
    records = {}
    for a, b in links:
        hops = {frozenset(h) for w in simple_walks(data, a, b, 4)[:3] for h in zip(w, w[1:])}
        records[f"missing_link | {a} | {b}"] = [r for r in data if frozenset(r[1:3]) in hops]
    for name, inside in (("x", lambda n: n < "n04"), ("y", lambda n: n >= "n04")):
        records[f"orphan_cluster | {name}"] = [r for r in data if inside(r[1]) and inside(r[2])]
    for c in decays:
        records[f"temporal_decay | {c}"] = [r for r in data if c in r[1:3]]
    want = Counter((k, r[4]) for k, v in records.items() for r in v)
    assert {(r["candidate"], r["paper_id"]): r["evidence_records"] for r in rows(spark, d, "gap_provenance_all")} == want
    inverse = {}
    for k, p in want:
        inverse.setdefault(p, set()).add(k)
    got = {r["paper_id"]: (r["candidates"], r["families"]) for r in rows(spark, d, "source_paper_inversion_all")}
    assert got == {p: (len(v), ",".join(sorted({k.split(" | ")[0] for k in v}))) for p, v in inverse.items()}


def test_abstracts_without_a_title_are_searched(spark, tiny):
    got = {r["doc"]: r["rank"] for r in rows(spark, tiny[0], "tfidf_top3_abstracts") if r["query"] == 20}
    assert got == {1: 1, 2: 2}


def test_betweenness_of_the_triples_and_its_depth(spark, tiny):
    d, data = tiny
    assert {r["node"] for r in rows(spark, d, "betweenness")} == {x for r in data for x in r[1:3]}
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(4)], "u string, v string")
    assert graph.betweenness(chain, max_depth=4).count() == 5
    with pytest.raises(RuntimeError, match="longer"):
        graph.betweenness(chain, max_depth=3)


def test_merging_takes_the_names_of_the_graph(spark, tiny, tmp_path):
    from lacuna.plans import pipeline

    assert {r["name"] for r in rows(spark, tiny[0], "fuzzy_merge")} == {x for r in tiny[1] for x in r[1:3]}
    t = [(i, (u, "M"), "USES", (v, "M"), 0.9, "", "p", "2020") for i, (u, v) in enumerate([("service mesh", "proxy"), ("service mesh", "cache"), ("mesh services", "proxy")])]
    spark.createDataFrame(t, TRIPLES).write.parquet(f"{tmp_path}/triples.parquet")
    assert {r["name"]: r["canonical"] for r in rows(spark, str(tmp_path), "fuzzy_merge")}["mesh services"] == "service mesh"
    assert pipeline.build_graph(spark.read.parquet(f"{tmp_path}/triples.parquet"))[0].count() == 3


@pytest.mark.parametrize("k", [4, 21, 5000])
def test_embedding_pairs_are_directed(spark, tiny, k):
    d, data = tiny
    near, directed = {}, {r[1:3] for r in data}
    for u, v in directed:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    want = sorted((-len(near[a] & near[b]), a, b) for a in near for b in near if a != b and near[a] & near[b] and (a, b) not in directed)
    assert any((b, a) in directed for _, a, b in want)
    got = detect.embedding_pairs(queries_graph.edges(spark, d), k).collect()
    assert sorted((r["head"], r["tail"]) for r in got) == sorted((a, b) for _, a, b in want[:k])
