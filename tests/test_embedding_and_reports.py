from pyspark.sql import functions as F

from lacuna.functions import identity
from lacuna.operators import embedding, reports


def test_training_lowers_the_loss_and_fits_a_pattern(spark):
    rows = [(f"a{i}", "USES", f"b{i % 4}") for i in range(40)] + [(f"b{i}", "EXTENDS", "c") for i in range(4)]
    e = spark.createDataFrame(rows, "u string, relation string, v string")
    nodes, rels, losses = embedding.train(e, dim=8, epochs=8)
    assert losses[-1] < losses[0] and nodes.count() == 45 and rels.count() == 2
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    assert nodes.where(F.abs(norm - 1) > 1e-6).count() == 0
    pairs = spark.createDataFrame([("a0", "b1"), ("a0", "b0")], "head string, tail string")
    got = embedding.links(e, pairs, 10, dim=8, epochs=2).collect()
    assert len(got) == 3 and ("a0", "USES", "b0") not in {(r["head"], r["relation"], r["tail"]) for r in got}


def test_too_few_triples(spark):
    assert embedding.train(spark.createDataFrame([("a", "USES", "b")], "u string, relation string, v string")) is None


def test_identities(spark):
    df = spark.createDataFrame([("missing_link", "a", "R", "b", None, None), ("orphan_cluster", None, None, None, None, ["z", "y"]), ("temporal_decay", None, None, None, "c", None)], "f string, h string, r string, t string, c string, m array<string>")
    got = df.select(identity.identity(*[F.col(c) for c in "fhrtcm"]).alias("i")).select("i", identity.review_key(F.col("i")).alias("k"), identity.stable_seed(F.col("i")).alias("s")).collect()
    assert [r["i"] for r in got] == ["missing_link|a|R|b", "orphan_cluster|y|z", "temporal_decay|c"]
    assert all(len(r["k"]) == 26 and 42 <= r["s"] < 42 + 2**32 for r in got)
    row = spark.createDataFrame([("Zero-Trust  Mesh!", {"2020": 1, "x": 2})], "a string, m map<string,int>").select(identity.slug(F.col("a")), identity.integer_keys(F.col("m")), identity.clamp(F.lit(99.0), 10, 50)).first()
    assert tuple(row) == ("zero_trust_mesh_", {2020: 1}, 50.0)


def test_reports(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "v double")
    assert {(r["bin"], r["n"]) for r in reports.histogram(df, "v", 2).collect()} == {(0, 1), (1, 2)}
    assert reports.histogram(df.limit(0), "v").count() == 0
    c = spark.createDataFrame([("the model", 0.9), ("mesh", 0.5), ("rare", 0.0), ("gap", 0.0)], "node string, centrality double")
    assert {r["node"] for r in reports.drawn_nodes(c, spark.createDataFrame([("gap",)], "node string")).collect()} == {"mesh", "gap"}
    a = spark.createDataFrame([(0, "p", "x"), (1, None, "y")], "position int, paper_id string, text string")
    b = spark.createDataFrame([(0, "q", "u"), (1, "p", "v")], "position int, paper_id string, text string")
    assert {r["text"]: r["other"] for r in reports.matched_outputs(a, b).collect()} == {"x": "v", "y": "v"}
    stats = {r["measure"]: r["value"] for r in reports.run_stats(a, a, a, b.withColumn("text", F.lit(" "))).collect()}
    assert stats["outputs"] == 2 and stats["outputs_with_text"] == 0
