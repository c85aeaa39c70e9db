import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import vocabulary as V


def brute(rows):
    n, recs = defaultdict(Counter), defaultdict(set)
    for rec, a, b in rows:
        for role, t in ((0, a), (1, b)):
            if t:
                n[t][role] += 1
                if rec is not None:
                    recs[t].add(rec)
    return {(t, c[0], c[1], len(recs[t])) for t, c in n.items()}


def random_rows(seed, n=800):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *[f"r{i}" for i in range(40)]]), rng.choice([None, "", "x", "y", f"t{rng.randrange(30)}"]), rng.choice([None, "x", f"t{rng.randrange(30)}"])) for _ in range(n)]
    return rows + [("hot", f"t{rng.randrange(30)}", "x") for _ in range(n // 2)] + rows[:50]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "rec string, s string, o string, block int")


@pytest.mark.parametrize("flush", [300_000, 7])
def test_frequencies(spark, flush, monkeypatch):
    monkeypatch.setattr(V, "FLUSH", flush)
    rows = random_rows(3)
    assert {tuple(r) for r in V.frequencies(V.build_index(frame(spark, rows), "rec", "s", "o")).collect()} == brute(rows)


def test_batches_of_an_index_opened_anew_equal_the_whole(spark, tmp_path):
    batches = [random_rows(5, 200), random_rows(6, 200), [], random_rows(7, 50)]
    for rows in batches:
        V.Vocabulary(spark, str(tmp_path)).add(frame(spark, rows), "rec", "s", "o")
    index = V.Vocabulary(spark, str(tmp_path)).index()
    assert {tuple(r) for r in V.frequencies(index).collect()} == brute([r for rows in batches for r in rows])
    assert index.groupBy("term", "block").count().where("count > 1").isEmpty()


def test_records_of_two_builds_stay_apart(spark, tmp_path):
    v = V.Vocabulary(spark, str(tmp_path))
    for low in (0, 5):
        v.add(spark.createDataFrame([(f"r{i}", "x") for i in range(low, low + 5)], "rec string, s string"), "rec", "s")
    assert [tuple(r) for r in V.frequencies(v.index()).collect()] == [("x", 10, 0, 10)]


def test_a_batch_that_broke_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    v = V.Vocabulary(spark, str(tmp_path))
    df = spark.createDataFrame([("r1", "x"), ("r2", "y")], "rec string, s string")
    with monkeypatch.context() as m:
        m.setattr(v.folder, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            v.add(df, "rec", "s")
    assert v.index().isEmpty()
    v.add(df, "rec", "s")
    assert {tuple(r) for r in V.frequencies(v.index()).collect()} == {("x", 1, 0, 1), ("y", 1, 0, 1)}


def test_dense_container_and_union():
    many = np.arange(0, 60_000, 3).astype("<u2")
    bits = V._bits(many)
    assert (V.numbers(bits, True) == many).all()
    raw, dense = V.union((bits, True), (np.array([1, 3], "<u2").tobytes(), False))
    assert dense and len(V.numbers(raw, dense)) == len(many) + 1
    assert V.union((b"\x01\x00", False), (b"\x01\x00\x02\x00", False)) == (b"\x01\x00\x02\x00", False)


def test_dense_cardinality_in_the_jvm(spark):
    df = spark.range(9000).select(F.lit("t").alias("t"), F.col("id").cast("string").alias("rec")).repartition(1)
    row = V.frequencies(V.build_index(df, "rec", "t")).first()
    assert (row["n_first"], row["records"]) == (9000, 9000)


def test_united_indexes(spark):
    a = spark.createDataFrame([("x", 1, bytearray(b"\x01\x00\x05\x00"), False, 3, 0)], V._SCHEMA)
    b = spark.createDataFrame([("x", 1, bytearray(b"\x05\x00\x07\x00"), False, 2, 1), ("y", 1, bytearray(b"\x01\x00"), False, 1, 0)], V._SCHEMA)
    got = {tuple(r) for r in V.frequencies(V.united(a.unionByName(b))).collect()}
    assert got == {("x", 5, 1, 3), ("y", 1, 0, 1)}


def test_marks_and_empty(spark):
    f = spark.createDataFrame([("a", 1, 1, 1), ("b", 3, 0, 2), ("c", 3, 0, 3)], "term string, n_first bigint, n_second bigint, records bigint")
    n = spark.createDataFrame([(200,)], "n bigint")
    assert {r["term"]: r["mark"] for r in V.marked(f, n).collect()} == {"a": "rare", "b": None, "c": "common"}
    empty = spark.createDataFrame([], "rec string, s string")
    assert V.frequencies(V.build_index(empty, "rec", "s")).count() == 0
