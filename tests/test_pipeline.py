from pyspark.sql import functions as F

from lacuna.plans import pipeline
from lacuna.plans.runtime import table
from lacuna.sources import files


def test_whole_chain(spark, small, tmp_path):
    out = pipeline.run(table(spark, small, "triples"), table(spark, small, "papers"))
    d = out["decisions"]
    families = {r["family"]: r["count"] for r in d.groupBy("family").count().collect()}
    assert set(families) == {"missing_link", "orphan_cluster", "temporal_decay"} and families["missing_link"] == 50
    assert d.where("status = 'rejected'").count() + out["eligible"].count() + out["review"].count() == d.count() == out["candidates"].count()
    assert d.where("stability < 0 or stability > 1 or ranking_score > 1.000001 or m_specificity is null").count() == 0
    ranks = [r["rank"] for r in out["ranked"].orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and out["ranked"].where("description is null").count() == 0
    files.write_ranked_csv(out["ranked"], str(tmp_path / "r"))
    files.write_gate(d, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == len(ranks)
    pipeline.write_run(str(tmp_path / "run"), out["nodes"], out["edges"], out["candidates"], table(spark, small, "papers"))
    again = pipeline.frozen_decisions(spark, str(tmp_path / "run"))
    key = lambda df: sorted(map(tuple, df.select("candidate", "status", F.array_join("reasons", ",")).collect()))
    assert key(again) == key(d)


def test_without_a_corpus_nothing_is_eligible(spark, small):
    out = pipeline.run(table(spark, small, "triples"), None, pipeline.Config(top_links=5))
    assert out["eligible"].count() == 0


def test_merged_names(spark):
    schema = "seq bigint, subject struct<name:string,type:string>, relation string, object struct<name:string,type:string>, confidence double, evidence string, source_paper_id string, source_year string"
    rows = [(i, (s, "M"), "USES", (o, "T"), 0.9, "", "p", "2020") for i, (s, o) in enumerate([("service mesh", "proxy"), ("service mesh", "cache"), ("mesh service", "proxy"), ("mesh services", "service mesh")])]
    nodes, edges = pipeline.build_graph(spark.createDataFrame(rows, schema), pipeline.Config(merge_names=True))
    assert {r["node"] for r in nodes.collect()} == {"service mesh", "proxy", "cache"} and edges.count() == 3


def test_corpus_stages(spark, small):
    p = table(spark, small, "papers")
    got = pipeline.collect_corpus(p, 20)
    assert 0 < got.count() <= 20 and got.select("paperId").distinct().count() == got.count()
    more = pipeline.collect_corpus(p.where("batch_no > 0"), 20, known=p.where("batch_no = 0"))
    assert more.count() >= p.where("batch_no = 0 and coalesce(paperId, '') not in ('', '0')").select("paperId").distinct().count()
    s = p.withColumn("screening", F.struct(F.lit(True).alias("relevant"), F.lit(0.8).alias("confidence"), F.lit("").alias("reason")))
    assert pipeline.screen_corpus(s, 5).count() == 5 and pipeline.screen_corpus(s, 5, 0.9).count() == 0
