"""Operators that no query uses, and the rank over a global sort."""

from pyspark.sql import functions as F

from lacuna.operators import corpus, evaluation, graph, reports, resolve
from lacuna.plans.runtime import ranked
from lacuna.sources import files


def test_ranked_over_many_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("v"), F.lit(1).alias("part_")).repartition(7)
    got = {r["v"]: r["rank"] for r in ranked(df.drop("part_"), F.desc("v")).collect()}
    assert got == {v: 500 - v for v in range(500)}
    assert ranked(df.drop("part_").limit(0), "v").isEmpty()


def test_queue_positions(spark):
    d = spark.createDataFrame([(1, "rejected"), (2, "automatically_eligible"), (3, "review_required"), (4, "automatically_eligible")], "seq int, status string")
    assert [r["seq"] for r in sorted(evaluation.queue_positions(d).collect(), key=lambda r: r["position"])] == [2, 4, 3, 1]


def test_cap_for_each_query(spark):
    df = spark.createDataFrame([("a", i) for i in range(300)] + [("b", 900)], "query string, seq int")
    got = corpus.per_query_cap(df, "query", 100, 2).groupBy("query").agg(F.count("*").alias("n"), F.max("seq").alias("last"))
    assert {tuple(r) for r in got.collect()} == {("a", 150, 149), ("b", 1, 900)}


def test_rich_triples_give_the_same_edges(spark):
    rich = spark.createDataFrame([(1, "JWT [METHOD]", "METHOD", "OAuth", "TOOL", "USES", 0.9, "p1", 2022, "quote"), (2, "jwt", None, "OAuth", None, "USES", None, "p2", None, None)], "seq bigint, subject string, subject_type string, object string, object_type string, relation string, confidence double, paper_id string, year int, evidence_quote string")
    got = sorted((r["u"], r["v"], r["source_paper"], r["year"], r["confidence"]) for r in graph.edges_from_triples(graph.from_rich(rich)).collect())
    assert got == [("jwt", "oauth", "p1", 2022, 0.9), ("jwt", "oauth", "p2", None, 0.5)]


def test_audit_sample_is_fixed_and_holds_merges_only(spark):
    m = spark.createDataFrame([(f"n{i}", f"n{i % 5}") for i in range(60)], "name string, canonical string")
    one, two = ([tuple(r) for r in resolve.audit_sample(m, 20).collect()] for _ in range(2))
    assert one == two and len(one) == 20 and all(a != b for a, b in one)


def test_blinded_ids_and_family_counts(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, family string")
    ids = [r[0] for r in df.select(evaluation.blinded_id(F.col("id"))).collect()]
    assert len(set(ids)) == 3 and all(len(i) == 10 for i in ids)
    assert {tuple(r) for r in reports.family_counts(df).collect()} == {("x", 2), ("y", 1)}


def test_json_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k bigint, t string")
    files.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.schema("k bigint, t string").json(str(tmp_path / "out")).collect())) == [(1, "a"), (2, None)]


def test_review_ledger_carries_only_decisions_on_the_same_candidate(spark):
    queue = spark.createDataFrame([("d", "temporal_decay", 0.5, ["r"], 2, 0), ("b", "missing_link", 0.6, ["r"], 2, 1), ("a", "missing_link", 0.7, ["r"], 3, 1), ("c", "orphan_cluster", 0.4, ["r"], 1, 1)], "candidate string, family string, ranking_score double, reasons array<string>, papers bigint, closure_hits bigint")
    before = spark.createDataFrame([("a", 1), ("c", 2), ("z", 3)], "candidate string, rank int")
    prior = spark.createDataFrame([(1, "Accept"), (2, "Pending"), (3, "Reject"), (9, None)], "rank int, decision string")
    got = sorted((r["queue_position"], r["candidate"], r["decision"], r["decision_source"]) for r in evaluation.review_ledger(queue, before, prior).collect())
    assert got == [(1, "a", "Accept", "carried_from_rank_1"), (2, "b", "Pending", "pending_author_review"), (3, "c", "Pending", "pending_author_review"), (4, "d", "Pending", "pending_author_review")]
