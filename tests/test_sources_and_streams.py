import json

import pytest
from pyspark.sql import functions as F

from lacuna.sources import files, model_calls, search_api
from lacuna.streaming import ingest, windows


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"seq": 1, "paperId": "a"}\n\n{"seq": 2, "paperId": "b"}\n')
    assert files.read_jsonl(spark, str(p), files.PAPER_SCHEMA).count() == 2
    p.write_text('{"seq": 1, "paperId": "a"}\n{broken\n')
    assert [r["paperId"] for r in files.read_jsonl(spark, str(p), files.PAPER_SCHEMA, tolerant=True).collect()] == ["a"]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed|malformed"):
        files.read_jsonl(spark, str(p), files.PAPER_SCHEMA).collect()


def test_json_and_checkpoints(spark, tmp_path):
    (tmp_path / "paper_1.json").write_text(json.dumps([{"seq": 1, "relation": "USES", "subject": {"name": "é", "type": "TOOL"}}]))
    (tmp_path / "paper_2.json").write_text("{nonsense")
    (tmp_path / "other.json").write_text("[]")
    assert files.read_json(spark, str(tmp_path / "paper_1.json"), files.TRIPLE_SCHEMA).first()["subject"]["name"] == "é"
    assert files.read_checkpoints(spark, str(tmp_path), files.TRIPLE_SCHEMA).count() == 1


def test_names_of_paper_columns(spark):
    raw = spark.createDataFrame([(None, "p", "2020"), ("", "q", "x")], "paperId string, id string, publication_year string")
    assert [(r["paperId"], r["year"]) for r in files.normalise_papers(raw).collect()] == [("p", 2020), ("q", None)]


def test_graph_round_trip_and_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("a & b", "TOOL"), ("c", None)], "node string, type string")
    edges = spark.createDataFrame([("a & b", "c", "USES", None, 2020)], "u string, v string, relation string, source_paper string, year int")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = files.read_graph(spark, str(tmp_path / "g"))
    assert n.count() == 2 and e.first()["year"] == 2020
    files.write_graphml(nodes, edges, str(tmp_path / "ml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "ml").glob("part-*")))
    import xml.etree.ElementTree as ET

    assert len(ET.fromstring(text.encode())[0]) == 3


def test_reports(spark, tmp_path):
    empty = spark.createDataFrame([], "rank int, family string, composite_score double, description string")
    files.write_ranked_csv(empty, str(tmp_path / "r"))
    assert "rank,type,score,description" in "".join(p.read_text() for p in (tmp_path / "r").glob("*.csv"))
    files.write_review_csv(spark.createDataFrame([(1, ["a", "b"])], "i int, l array<string>"), str(tmp_path / "v"))
    assert "a; b" in "".join(p.read_text() for p in (tmp_path / "v").glob("*.csv"))
    d = spark.createDataFrame([("x", "rejected"), ("y", "review_required")], "c string, status string")
    files.write_gate(d, str(tmp_path / "gate"))
    assert spark.read.parquet(str(tmp_path / "gate/review")).count() == 1 and spark.read.parquet(str(tmp_path / "gate/eligible")).count() == 0


def test_corpus_and_candidate_inputs(spark, tmp_path):
    assert files.resolve_corpus(spark, None, str(tmp_path)) is None
    spark.range(0).write.parquet(str(tmp_path / "filtered_papers"))
    assert files.resolve_corpus(spark, None, str(tmp_path)).count() == 0
    df = spark.range(1)
    assert files.candidate_input(None, None, df)[1] is False and files.candidate_input(df, None, None)[1] is True
    with pytest.raises(ValueError):
        files.candidate_input(None, None, None)


def test_manifest(spark, tmp_path):
    (tmp_path / "run1").mkdir()
    (tmp_path / "run1" / "a.txt").write_text("a")
    m = files.manifest(spark, str(tmp_path))
    assert m.first()["sha256"].startswith("ca978112ca1bbdca") and len(files.manifest_digest(m).first()["digest"]) == 64
    assert files.run_catalog(spark, str(tmp_path)).first()["run"] == "run1"


PAGE = (200, {}, json.dumps({"data": [{"paperId": "p", "title": "t", "year": 2020}], "token": None}))


def transport(replies):
    it = iter(replies)
    return lambda url, timeout: next(it)


def test_search_retries(spark):
    slept = []
    got = list(search_api.pages(transport([(500, {}, ""), PAGE]), "http://x", "q", "2019-2025", 1, 10, 3, 15, 20, slept.append))
    assert len(got) == 1 and slept == [1]
    with pytest.raises(search_api.SearchError):
        list(search_api.pages(transport([(500, {}, "")] * 3), "http://x", "q", "", 1, 10, 3, 15, 20, slept.append))
    slept.clear()
    with pytest.raises(search_api.SearchError):
        list(search_api.pages(transport([(429, {"Retry-After": "120"}, "")] * 2), "http://x", "q", "", 1, 10, 2, 15, 7, slept.append))
    assert slept == [7]
    more = (200, {}, json.dumps({"data": [{"paperId": str(i)} for i in range(4)], "token": "n"}))
    assert len(list(search_api.pages(transport([more, more]), "http://x", "q", "", 1, 6, 2, 15, 7))) == 6


def offline(url, timeout):
    return PAGE


def test_search_source(spark):
    spark.dataSource.register(search_api.PaperSearch)
    spark.sparkContext.addPyFile(__file__)
    df = spark.read.format("paper_search").option("endpoint", "http://x").option("queries", "a; b").option("transport", "test_sources_and_streams:offline").load()
    assert sorted((r["query"], r["paperId"]) for r in df.collect()) == [("a", "p"), ("b", "p")]


def client():
    calls = {"n": 0}

    def ask(prompt):
        calls["n"] += 1
        if "fail" in prompt or ("once" in prompt and calls["n"] == 1):
            raise TimeoutError("late")
        if "quota" in prompt:
            raise model_calls.QuotaExceeded("daily")
        return '```json\n{"triples": [{"subject": {"name": " A ", "type": "TOOL"}, "relation": "USES", "object": {"name": "B"}}, {"relation": "USES"}]}\n```'

    return ask


def test_model_calls(spark):
    from pyspark import cloudpickle
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    df = spark.createDataFrame([("a", "once"), ("b", "fail"), ("c", None), ("d", "ok")], "id string, p string").coalesce(1)
    got = {r["id"]: r for r in model_calls.answers(df, "id", "p", client, 2, 0.0).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["answer"] and got["b"]["answer"] is None and "TimeoutError" in got["b"]["error"]
    done = spark.createDataFrame([("d",)], "id string")
    assert {r["id"] for r in model_calls.answers(df, "id", "p", client, 1, 0.0, done).collect()} == {"a", "b"}
    with pytest.raises(Exception, match="daily"):
        model_calls.answers(spark.createDataFrame([("q", "quota")], "id string, p string"), "id", "p", client).collect()
    papers = spark.createDataFrame([("p1", 2020, "t", "an abstract"), ("p2", None, None, None)], "paperId string, year int, title string, abstract string")
    out = model_calls.extract_triples(papers, "{title}: {text}", client, wait=0.0).collect()
    assert [(r["subject"]["name"], r["confidence"], r["source_paper_id"], r["source_year"]) for r in out] == [("A", 0.5, "p1", "2020")]


def baseline_client():
    return lambda prompt: f"RESEARCH_GAPS: {len(prompt)}\nREMAINING_GAPS: none" if "fields" in prompt else "one\ntwo\n\nthree\nfour"


def test_baselines(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    p = spark.createDataFrame([("a", "mesh", "service mesh traces"), ("b", "mesh", "service mesh logs"), ("c", "x", None), ("d", "lattice", "lattice keys")], "paperId string, title string, abstract string")
    got = {r["paperId"]: r for r in model_calls.retrieval_baseline(p, "fields {text} / {context}", baseline_client, wait=0.0).collect()}
    assert set(got) == {"a", "b", "d"} and got["a"]["neighbours"] == ["b"] and got["d"]["neighbours"] == [] and got["a"]["remaining_gaps"] == "none"
    lines = model_calls.abstract_baseline(p, "{title} {abstract}", baseline_client, wait=0.0).collect()
    assert sorted({r["text"] for r in lines}) == ["one", "three", "two"] and len(lines) == 9


def test_answer_parsers(spark):
    one = lambda text, col: spark.createDataFrame([(text,)], "x string").select(col.alias("c")).first()["c"]
    assert tuple(one('{"relevant": true, "confidence": "0.9"}', model_calls.parse_screening(F.col("x")))) == (True, 0.9, "")
    assert tuple(one("no json", model_calls.parse_screening(F.col("x")))) == (False, 0.0, "")
    assert one('```json\n["a", "b", "c", "d"]\n```', model_calls.parse_gap_list(F.col("x"))) == ["a", "b", "c"]
    assert one("first\n\n second\nthird\nfourth", model_calls.parse_gap_list(F.col("x"))) == ["first", "second", "third"]
    assert model_calls.expand_query("x")[0] == "x" and model_calls.expand_query("x", '{"queries": ["a", "b", "c", " d ", "e"]}') == ["a", "b", "c", "d", "e"]
    assert len(model_calls.expand_query("x", '{"queries": ["a"]}')) == 5 and len(model_calls.expand_query("x", "no json")) == 5


def test_stream_of_new_papers(spark, tmp_path):
    seen = []
    listener = ingest.Progress(lambda batch, rows: seen.append(rows))
    spark.streams.addListener(listener)
    src = tmp_path / "in"
    src.mkdir()
    out = 0
    for n, ids in enumerate((["a", "b", "a"], ["b", "c", ""])):
        (src / f"{n}.jsonl").write_text("".join(json.dumps({"seq": i, "paperId": x}) + "\n" for i, x in enumerate(ids)))
        ingest.append(ingest.new_papers(spark, str(src), files.PAPER_SCHEMA), str(tmp_path / "t"), str(tmp_path / "ck"), str(tmp_path / "m")).awaitTermination()
        out = spark.read.parquet(str(tmp_path / "t")).count()
    assert out == 3
    import time

    for _ in range(50):
        if sum(seen) >= 6:
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert sum(seen) == 6
    assert [r["rows"] for r in spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "m")).orderBy("batch").collect()] == [2, 1]


def test_windows_on_table_and_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    table = windows.tumbling(events, "1 day")
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.parquet(str(tmp_path / "in"), mode="overwrite")
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "1 day", "1 hour")
    q = stream.writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    last = table.agg(F.max("day")).first()[0]
    closed = events.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    want = {(r["day"], r["event_type"]): r["events"] for r in table.collect() if r["day"] < last or r["day"].timestamp() + 86400 <= closed.timestamp()}
    assert {(r["day"], r["event_type"]): r["events"] for r in spark.table("w").collect()} == want
