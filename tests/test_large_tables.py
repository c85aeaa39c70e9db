"""What keeps queries small over large tables: rows that need not be made are not made."""

from pyspark.sql import functions as F

from lacuna.operators import paths, retrieval
from lacuna.plans.runtime import Scratch


def saved(monkeypatch, name):
    """The row counts of the scratch tables of this name, from now on."""
    counts, save = [], Scratch.save

    def counted(self, df, n="t"):
        out = save(self, df, n)
        if n == name:
            counts.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    return counts


def test_longer_paths_are_not_listed_where_short_ones_hold_their_ends(spark, monkeypatch):
    x = [("h", "p"), ("p", "t"), ("h", "q"), ("q", "t"), ("h", "s"), ("t", "s2"), ("s", "s2")] + [(f"m{i}", hub) for i in range(40) for hub in ("p", "q")]
    e = spark.createDataFrame([(i, u, v, f"paper{i}") for i, (u, v) in enumerate(x)], "edge_seq long, u string, v string, source_paper string")
    rows = saved(monkeypatch, "found")
    got = paths.independent_paths(e, spark.createDataFrame([("h", "t")], "head string, tail string"))
    assert [(r["path_no"], r["nodes"]) for r in got.orderBy("path_no").collect()] == [(1, ["h", "p", "t"]), (2, ["h", "q", "t"]), (3, ["h", "s", "s2", "t"])]
    assert sum(rows) == 3  # the 80 paths over p, some m and q begin with edges that are held
    near = paths.shortest_paths(e.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")), spark.createDataFrame([("h", "t"), ("h", "h")], "head string, tail string"), 4, 2)
    assert [(r["path_no"], r["nodes"]) for r in near.orderBy("path_no").collect()] == [(1, ["h", "p", "t"]), (2, ["h", "q", "t"])]


def test_texts_in_blocks_are_those_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TEXTS", 40)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu".split()
    texts = [(i, None if i % 41 == 7 else " ".join(words[i * j % 13] if j % 3 else f"w{i * j % 29}" for j in range(1, 2 + i % 9)) if i % 17 else "") for i in range(150)]
    docs = spark.createDataFrame(texts, "doc long, text string").repartition(3)
    want = retrieval.top_similar(retrieval.tfidf(docs, 30), docs.where("doc % 3 = 0").select(F.col("doc").alias("query")), 3, 6)
    got = retrieval.nearest_texts(docs.withColumn("asks", F.col("doc") % 3 == 0), 3, 6, 30)
    assert sorted(map(tuple, got.select("query", "doc", "similarity", "rank").collect())) == sorted(map(tuple, want.select("query", "doc", "similarity", "rank").collect()))
    assert retrieval.nearest_texts(docs.limit(0).withColumn("asks", F.lit(True))).isEmpty()
