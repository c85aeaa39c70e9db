import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lacuna.operators import detect, graph, paths, resolve

TRIPLES = "seq bigint, subject struct<name:string,type:string>, relation string, object struct<name:string,type:string>, confidence double, evidence string, source_paper_id string, source_year string"


def triples(spark, rows):
    return spark.createDataFrame([(i, (s, "METHOD"), r, (o, "TOOL"), c, "ev", p, y) for i, (s, r, o, c, p, y) in enumerate(rows)], TRIPLES)


def pairs(spark, edges):
    return spark.createDataFrame([tuple(sorted(e)) for e in edges], "a string, b string").distinct()


def test_edges_filters_and_index(spark):
    t = triples(spark, [
        ("JWT [METHOD]", "USES", "Mesh", None, "p1", "2020"), ("jwt", "USES", "mesh", 0.9, "p2", "2020.0"), ("Scalability [CONCEPT]", "USES", "scalability [METRIC]", 0.9, "p", "2020"),
        ("a", "KNOWS", "b", 0.9, "p", "2020"), ("a", "USES", "b", 0.1, "p", "2020"), ("Our Method", "USES", "b", 0.9, "p", "2020"), (None, "USES", "b", 0.9, "p", "2020"), (" ", "USES", "b", 0.9, "p", "2020"), ("a", None, "b", 0.9, "p", "2020"),
    ])
    e = graph.edges_from_triples(t)
    assert [(r["u"], r["v"], r["confidence"], r["year"]) for r in e.orderBy("edge_seq").collect()] == [("jwt", "mesh", 0.5, 2020), ("jwt", "mesh", 0.9, None)]
    index = {r["node"]: r for r in graph.entity_index(e).collect()}
    assert index["jwt"]["label"] == "JWT" and index["jwt"]["occurrences"] == 2 and index["jwt"]["papers"] == 2


def test_empty_graph(spark):
    e = graph.edges_from_triples(triples(spark, []))
    assert graph.entity_index(e).count() == 0 and graph.weak_components(graph.simple(e)).count() == 0 and graph.betweenness(e).count() == 0
    assert detect.temporal_decay(e).count() == 0 and detect.communities(graph.simple(e)).count() == 0
    assert graph.graph_stats(e).first()["nodes"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_weak_components(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample([f"n{i}" for i in range(90)], 2))) for _ in range(60)} | {(f"z{i:02}", f"z{i + 1:02}") for i in range(40)}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = [tuple(r) for r in graph.weak_components(pairs(spark, edges)).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in list(parent))


def test_common_neighbours_match_brute_force(spark):
    rng = random.Random(4)
    edges = {tuple(sorted(rng.sample([f"n{i:02}" for i in range(20)], 2))) for _ in range(50)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for h, t in combinations(sorted(near), 2):
        n = len(near[h] & near[t])
        if n and t not in near[h]:
            want[h, t] = (10 * (n / (len(near[h]) * len(near[t])) ** 0.5), n)
    order = sorted(want, key=lambda p: (round(want[p][0], 9), want[p][1], *p), reverse=True)[:10]
    got = detect.common_neighbor_links(pairs(spark, edges), 10).collect()
    assert [(r["head"], r["tail"]) for r in got] == order
    assert {(r["head"], r["tail"]): r["common_neighbors"] for r in detect.two_hop_pairs(pairs(spark, edges)).collect()} == {p: v[1] for p, v in want.items()}


def test_betweenness_of_a_path_and_a_diamond(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "e"), ("d", "e"), ("b", "c")], "u string, v string")
    got = {r["node"]: r["betweenness"] for r in graph.betweenness(e).collect()}
    assert got == {"a": 0.0, "b": 3 / 12, "c": 1.0 / 12, "d": 1.0 / 12, "e": 0.0}


def test_communities_find_planted_cliques(spark):
    edges = [(f"c{k}-{i}", f"c{k}-{j}") for k in range(4) for i, j in combinations(range(6), 2)] + [(f"c{k}-0", f"c{(k + 1) % 4}-1") for k in range(4)]
    p = pairs(spark, edges)
    m = detect.communities(p)
    groups = defaultdict(set)
    for r in m.collect():
        groups[r["community"]].add(r["node"].split("-")[0])
    assert sorted(map(sorted, groups.values())) == [["c0"], ["c1"], ["c2"], ["c3"]]
    assert detect.modularity(p, m).first()[0] > 0.6
    stats = {r["community"]: r for r in detect.cluster_stats(p, m).collect()}
    assert all(r["size"] == 6 and r["intra_edges"] == 15 and r["inter_edges"] == 2 for r in stats.values())
    assert detect.orphan_clusters(p, m, mode="and").count() == 0
    assert detect.orphan_clusters(p, m, min_ratio=0.3).count() == 4


def decay_edges(spark, rows):
    return spark.createDataFrame([(i, u, v, p, y) for i, (u, v, p, y) in enumerate(rows)], "edge_seq bigint, u string, v string, source_paper string, year int")


def test_decay_needs_a_baseline(spark):
    e = decay_edges(spark, [("old", "x", f"p{i}", 2020) for i in range(3)])
    counts = spark.createDataFrame([(y, 10) for y in range(2020, 2026)], "year int, publications bigint")
    wide = e.unionByName(decay_edges(spark, [("k", "l", "q", 2025)]))
    assert detect.temporal_decay(wide, publications=counts).count() == 0


def test_decay_from_positive_to_zero(spark):
    rows = [("fading", f"o{y}{i}", f"p{y}{i}", y) for y in (2022, 2023) for i in range(2)] + [("other", "else", "q", 2025)]
    got = detect.temporal_decay(decay_edges(spark, rows)).collect()
    assert [(r["concept"], r["decay_rate"], r["total_activity"], r["peak_year"]) for r in got] == [("fading", 1.0, 4, 2022)]


def test_partial_final_year_is_left_out(spark):
    e = decay_edges(spark, [("a", "b", "p", 2024), ("a", "b", "q", 2026)])
    assert detect.year_bounds(e, "2026-07-20").first()["max_year"] == 2025
    assert detect.year_bounds(e, "2027-01-01").first()["max_year"] == 2026
    assert detect.year_bounds(e, None).first()["max_year"] == 2026


def all_paths(edges, head, tail, cutoff):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, todo = set(), [(head,)]
    while todo:
        p = todo.pop()
        if p[-1] == tail:
            out.add(p)
        elif len(p) <= cutoff:
            todo += [(*p, n) for n in near[p[-1]] if n not in p]
    return out


@pytest.mark.parametrize("cutoff", [1, 2, 3, 4])
def test_simple_paths_match_brute_force(spark, cutoff):
    rng = random.Random(cutoff)
    edges = {tuple(sorted(rng.sample([f"n{i:02}" for i in range(14)], 2))) for _ in range(26)}
    ends = [tuple(rng.sample([f"n{i:02}" for i in range(14)], 2)) for _ in range(5)] + [("n01", "n01"), ("n01", "nowhere")]
    got = paths.simple_paths(pairs(spark, edges), spark.createDataFrame(ends, "head string, tail string"), cutoff).collect()
    want = Counter((h, t, p) for h, t in set(ends) if h != t for p in all_paths(edges, h, t, cutoff))
    assert Counter((r["head"], r["tail"], tuple(r["nodes"])) for r in got) == want


def test_independent_paths_share_neither_edge_nor_paper(spark):
    rows = [("A", "m1", "p1", 2022), ("m1", "B", "p3", 2022), ("A", "m2", "p2", 2024), ("m2", "B", "p4", 2024), ("A", "m3", "p1", 2024), ("m3", "B", "p9", 2024), ("A", "m4", None, 2024), ("m4", "B", "p10", 2024)]
    e = decay_edges(spark, rows)
    got = paths.independent_paths(e, spark.createDataFrame([("A", "B")], "head string, tail string"))
    assert [(r["path_no"], r["nodes"]) for r in sorted(got.collect(), key=lambda r: r["path_no"])] == [(1, ["A", "m1", "B"]), (2, ["A", "m2", "B"])]
    assert sorted((r["path_no"], r["item"]) for r in paths.path_papers(got, paths.edge_papers(e)).collect()) == [(1, "p1"), (1, "p3"), (2, "p2"), (2, "p4")]


@pytest.mark.parametrize("seed", [1, 2])
def test_independent_paths_are_those_of_the_greedy_order(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(11)]
    rows = [(*rng.sample(names, 2), rng.choice([None, *[f"p{i}" for i in range(14)]]), 2022) for _ in range(60)]
    e = decay_edges(spark, rows)
    ends = [tuple(rng.sample(names, 2)) for _ in range(4)]
    sources = {}
    for u, v, p, _ in rows:
        if p:
            sources.setdefault(tuple(sorted((u, v))), set()).add(p)
    want = {}
    for h, t in set(ends):
        held = set()
        for nodes in sorted(all_paths({tuple(sorted(r[:2])) for r in rows}, h, t, 4), key=lambda p: (len(p), p)):
            hops = [tuple(sorted(x)) for x in zip(nodes, nodes[1:])]
            items = set(hops).union(*(sources.get(x, ()) for x in hops))
            if all(x in sources for x in hops) and not items & held:
                held |= items
                want.setdefault((h, t), []).append(list(nodes))
    got = {}
    for r in sorted(paths.independent_paths(e, spark.createDataFrame(ends, "head string, tail string")).collect(), key=lambda r: r["path_no"]):
        got.setdefault((r["head"], r["tail"]), []).append(r["nodes"])
    assert want and got == want


def test_evidence_falls_back_on_shortest_paths(spark):
    e = decay_edges(spark, [("A", "m", "p1", 2022), ("m", "B", "p2", 2022), ("C", "k", None, 2022), ("k", "D", "p3", 2022), ("C", "j", None, 2022), ("j", "D", None, 2022)])
    got = paths.evidence(e, spark.createDataFrame([("A", "B"), ("C", "D")], "head string, tail string"))
    assert sorted((r["head"], r["path_no"], r["nodes"][1]) for r in got.collect()) == [("A", 1, "m"), ("C", 1, "j"), ("C", 2, "k")]


def test_greedy_merge_is_not_transitive(spark):
    names = spark.createDataFrame([("service mesh", 5, 1), ("mesh service", 3, 2), ("service meshes", 9, 3), ("unrelated", 1, 4), ("services meshes", 2, 5)], "name string, occurrences bigint, seq bigint")
    p = resolve.fuzzy_pairs(names.select("name"), 85)
    got = {r["name"]: r["canonical"] for r in resolve.greedy_merge(names, p).collect()}
    assert got == {"service meshes": "service meshes", "service mesh": "service meshes", "mesh service": "service meshes", "services meshes": "service meshes", "unrelated": "unrelated"}


def test_fuzzy_pairs_match_brute_force(spark):
    from lacuna.functions.text import indel_ratio, sort_key

    rng = random.Random(6)
    names = sorted({" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 4))) for _ in range(60)} | {"abcd eabc", "eabc abcd", "abcd eab", "x"})
    got = {(r["x"], r["y"]) for r in resolve.fuzzy_pairs(spark.createDataFrame([(n,) for n in names], "name string"), 85).collect()}
    assert got == {(a, b) for a, b in combinations(names, 2) if round(indel_ratio(sort_key(a), sort_key(b))) >= 85}


def test_similar_vectors(spark, monkeypatch):
    from lacuna.operators import retrieval

    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 1.0]), ("z", [0.0, 0.0]), ("n", None), ("e", []), ("long", [1.0, 0.0, 0.0])], "name string, vec array<double>")
    for rows in (2048, 2):
        monkeypatch.setattr(retrieval, "ROWS", rows)
        assert [(r["x"], r["y"]) for r in retrieval.similar_vectors(v, "name", "vec").collect()] == [("a", "b")]
        near = retrieval.nearest_vectors(v.withColumnRenamed("name", "doc"), spark.createDataFrame([("a",), ("z",), ("n",)], "query string"), 1).collect()
        assert [(r["query"], r["doc"], r["rank"]) for r in near] == [("a", "b", 1)]


def test_names_merge_by_spelling_then_by_meaning(spark):
    names = spark.createDataFrame([("service mesh", 5, 1), ("mesh service", 3, 2), ("sidecar network", 9, 3), ("other", 1, 4)], "name string, occurrences bigint, seq bigint")
    vectors = spark.createDataFrame([("service mesh", [1.0, 0.1]), ("mesh service", [0.0, 1.0]), ("sidecar network", [1.0, 0.0]), ("other", [-1.0, 0.0])], "name string, vec array<double>")
    got = {r["name"]: (r["canonical"], r["method"]) for r in resolve.merge_names(names, 85, vectors).collect()}
    assert got == {"service mesh": ("sidecar network", "cosine"), "mesh service": ("sidecar network", "fuzzy"), "sidecar network": ("sidecar network", None), "other": ("other", None)}


def test_embedding_candidates_and_scores(spark):
    e = spark.createDataFrame([("a", "m"), ("m", "b"), ("b", "a")], "u string, v string")
    c = detect.embedding_candidates(e, spark.createDataFrame([("USES",)], "relation string"))
    assert {(r["head"], r["tail"]) for r in c.collect()} == {("a", "b"), ("b", "m"), ("m", "a")}
    vecs = spark.createDataFrame([("a", [0.0]), ("m", [1.0]), ("b", [3.0])], "node string, vec array<double>")
    rel = spark.createDataFrame([("USES", [3.0])], "relation string, vec array<double>")
    best = detect.translation_scores(c, vecs, rel, 1).first()
    assert (best["head"], best["tail"], best["prediction_score"]) == ("a", "b", 0.0)


def test_rename_drops_new_loops(spark):
    e = decay_edges(spark, [("a", "b", "p", 2020), ("a", "c", "p", 2020)])
    m = spark.createDataFrame([("b", "a"), ("a", "a"), ("c", "c")], "name string, canonical string")
    assert [(r["u"], r["v"]) for r in resolve.apply_names(e, m).collect()] == [("a", "c")]
    assert e.select(F.count("*")).first()[0] == 2
