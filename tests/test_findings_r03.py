"""What the findings of the third round were about: betweenness without a row for each two nodes."""

import random
from collections import defaultdict, deque

import pyarrow as pa
import pytest

from lacuna.operators import between, graph


def by_hand(edges):
    """({node: betweenness}, longest shortest path), one search after another."""
    out, value, longest = defaultdict(set), {x: 0.0 for e in edges for x in e}, 0
    for a, b in edges:
        out[a].add(b)
    for s in value:
        far, paths, before, met = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
        queue = deque([s])
        while queue:
            met.append(x := queue.popleft())
            for y in out[x]:
                if y not in far:
                    far[y] = far[x] + 1
                    queue.append(y)
                if far[y] == far[x] + 1:
                    paths[y] += paths[x]
                    before[y].append(x)
        owed, longest = defaultdict(float), max(longest, *far.values())
        for y in reversed(met):
            for x in before[y]:
                owed[x] += paths[x] / paths[y] * (1 + owed[y])
            value[y] += owed[y] if y != s else 0.0
    n = len(value)
    return {x: v / ((n - 1) * (n - 2)) if n > 2 else 0.0 for x, v in value.items()}, longest


def drawn(seed, n, m):
    """Edges with a hub, ends with one way in, chains, rings and nodes with one way out."""
    r = random.Random(seed)
    e = {(f"n{r.randrange(n):02}", "n00" if r.random() < 0.2 else f"n{r.randrange(n):02}") for _ in range(m)}
    e |= {(f"n{r.randrange(n):02}", f"end{i}") for i in range(6)} | {(f"start{i}", f"n{r.randrange(n):02}") for i in range(6)}
    e |= {("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("p0", "p1"), ("p1", "p0"), ("c0", "c1"), ("c1", "c2"), ("c2", "n00")}
    return sorted((a, b) for a, b in e if a != b)


def in_blocks(edges, max_depth=100):
    """{node: betweenness} by between alone; None where paths are too long."""
    value, names = {}, sorted({x for e in edges for x in e})
    columns = [pa.array([names.index(e[i]) for e in edges], pa.int64()) for i in (0, 1)]
    g = between.unpacked(r for b in between.packed(iter([pa.RecordBatch.from_arrays(columns, ["a", "b"])])) for r in zip(*(c.to_pylist() for c in b)))
    numbers = pa.RecordBatch.from_arrays([pa.array(range(between.blocks(g)), pa.int64())], ["id"])
    for b in between.made(iter([numbers]), g, max_depth):
        value |= dict(zip(*(c.to_pylist() for c in b)))
    n = len(names)
    return None if None in value else {x: value.get(i, 0.0) / ((n - 1) * (n - 2)) for i, x in enumerate(names)}


@pytest.mark.parametrize("seed", range(12))
def test_blocks_of_searches_give_what_single_searches_give(monkeypatch, seed):
    for name, value in (("SEARCHES", (1, 5, 64)[seed % 3]), ("ROWS", 4), ("RUN", 2), ("PIECE", 24)):
        monkeypatch.setattr(between, name, value)
    edges = drawn(seed, 30, (20, 45, 150)[seed // 4])
    want, longest = by_hand(edges)
    assert in_blocks(edges, longest) == pytest.approx(want, abs=1e-12)
    assert in_blocks(edges, longest - 1) is None


def test_a_ring_and_what_hangs_on_it():
    ring = [(f"r{i}", f"r{(i + 1) % 5}") for i in range(5)]
    for edges in (ring, [*ring, ("s0", "r2"), ("s1", "r2"), ("r3", "end")], [*ring, ("r2", "x"), ("x", "r2"), ("y", "x"), ("z", "y")]):
        want, longest = by_hand(edges)
        assert in_blocks(edges, longest) == pytest.approx(want, abs=1e-12) and in_blocks(edges, longest - 1) is None


@pytest.mark.parametrize("one_graph", [graph.ONE_GRAPH, 0])
def test_betweenness_by_blocks_and_by_joins(spark, monkeypatch, one_graph):
    monkeypatch.setattr(graph, "ONE_GRAPH", one_graph)
    edges = drawn(1, 12, 20)
    want, longest = by_hand(edges)
    e = spark.createDataFrame([*edges, *edges[:5], ("n00", "n00")], "u string, v string")
    assert {r["node"]: r["betweenness"] for r in graph.betweenness(e, longest).collect()} == pytest.approx(want, abs=1e-12)
    with pytest.raises(RuntimeError, match="longer"):
        graph.betweenness(e, longest - 1)


def test_betweenness_writes_sums_a_node_and_no_pairs(spark, small, monkeypatch):
    from lacuna import queries_graph

    saved = []
    monkeypatch.setattr(graph.Scratch, "save", lambda self, df, name="t", save=graph.Scratch.save: saved.append((name, out := save(self, df, name), out.count())) or out)
    nodes = queries_graph.betweenness(spark, small).count()
    rows = {name: n for name, _, n in saved}
    tasks = graph.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert set(rows) == {"edges", "nodes", "pairs", "graph", "parts"} and rows["parts"] <= nodes * tasks
