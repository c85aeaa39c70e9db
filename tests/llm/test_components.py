import random

import pytest

from lacuna.llm.components import connected_components


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {(x, find(x)) for x in list(parent)}


def run(spark, pairs, kind="string"):
    df = spark.createDataFrame([(a, b, "x", "y") for a, b in pairs], f"l {kind}, r {kind}, node string, u string")
    return [tuple(r) for r in connected_components(df, "l", "r").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_links_match_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(120)}", f"n{rng.randrange(120)}") for _ in range(80)]
    got = run(spark, pairs)
    assert len(got) == len(set(got)) and set(got) == brute(pairs)


def test_long_chain_and_star(spark):
    pairs = [(f"c{i:03}", f"c{i + 1:03}") for i in range(100)] + [("hub", f"s{i}") for i in range(150)]
    assert set(run(spark, pairs)) == brute(pairs)


def test_nulls_loops_repeats_and_empty(spark):
    assert run(spark, [(None, "a"), ("a", None), ("b", "b"), (None, None)]) == []
    assert run(spark, []) == []
    assert set(run(spark, [("b", "a"), ("a", "b"), ("a", "b"), ("", "b")])) == {("a", ""), ("b", ""), ("", "")}


def test_numbers_and_order_by_bytes(spark):
    assert set(run(spark, [(3, 20), (20, 100)], "bigint")) == {(3, 3), (20, 3), (100, 3)}
    assert set(run(spark, [("é", "z"), ("Z", "z")])) == {("é", "Z"), ("z", "Z"), ("Z", "Z")}
