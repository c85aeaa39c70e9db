import random

from lacuna.llm.mixing import mix

TARGETS = "source string, target_share double, max_repeats int, docs int"


def make(spark, docs, targets):
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, source string, n int, part int")
    return mix(d, spark.createDataFrame([(*t, 0) for t in targets], TARGETS), "doc_id", "source", "n")


def test_shares_and_caps(spark):
    rng = random.Random(1)
    docs = [(i, rng.choice(["Big ", "big", " BIG\n"]) if i % 5 else "small", rng.randrange(1, 500)) for i in range(4000)]
    drawn, shares = make(spark, docs, [("big", 0.6, 1), ("Small", 0.4, 3), ("absent", 0.1, 2)])
    rows = drawn.collect()
    sizes = {i: n for i, _, n in docs}
    assert all(r["n_tokens"] == sizes[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], r["copy_no"]) for r in rows}) == len(rows)
    s = {r["source"]: r for r in shares.collect()}
    assert set(s) == {"big", "small", "absent"} and s["absent"]["tokens_mix"] == 0
    for name in ("big", "small"):
        got = sum(r["n_tokens"] for r in rows if r["source"] == name)
        assert got == s[name]["tokens_mix"] and abs(got - s[name]["tokens_target"]) <= 501
        assert s[name]["most_copies"] <= s[name]["max_repeats"]
    assert abs(s["big"]["actual_share"] - 0.6) < 0.01
    total = sum(r["tokens_mix"] for r in s.values())
    small = sum(n for _, c, n in docs if c == "small")
    big = sum(sizes.values()) - small
    assert abs(total - min(big + small, big / 0.6, 3 * small / 0.4)) < 1100


def test_copies_differ_by_one_at_most(spark):
    drawn, _ = make(spark, [(i, "a", 10) for i in range(100)] + [(1000 + i, "b", 10) for i in range(500)], [("a", 0.5, 4), ("b", 0.5, 4)])
    per = {r["doc_id"]: r["count"] for r in drawn.where("source = 'a'").groupBy("doc_id").count().collect()}
    assert set(per.values()) <= {3} and len(per) == 100


def test_degenerate_inputs(spark):
    drawn, shares = make(spark, [], [("a", 1.0, 1)])
    assert drawn.count() == 0 and shares.first()["actual_share"] == 0.0
    drawn, shares = make(spark, [(1, None, 5), (2, "x", None), (3, "a", 0), (4, "a", 7)], [("a", 1.0, 1), (None, 0.5, 1), ("z", None, None)])
    assert {r["doc_id"] for r in drawn.collect()} == {4} and {r["source"]: r["docs"] for r in shares.collect()} == {"a": 1, "z": 0}
    assert make(spark, [(1, "a", 1)], [])[0].count() == 0
