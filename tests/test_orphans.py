import random
from datetime import datetime, timedelta

import pytest

from lacuna.operators.orphans import OrphanLedger, Source, orphan_counts, orphan_references
from lacuna.streaming.orphans import track

T0 = datetime(2024, 1, 10)


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def sources(spark, parents, gone, refs):
    p = spark.createDataFrame([(i, day(d), "x") for i, d in parents], "paperId string, at timestamp, month string")
    g = spark.createDataFrame([(i, day(d)) for i, d in gone], "paperId string, at timestamp")
    r = spark.createDataFrame([(k, i, day(d), True, "m") for k, i, d in refs], "seq bigint, paperId string, at timestamp, here boolean, id string")
    return {"t": Source(r, "paperId", "at", "seq")}, Source(p, "paperId", "at"), Source(g, "paperId", "at")


def brute(parents, gone, refs):
    norm = lambda i: (i or "").strip(" \t\r\n").lower()
    out = []
    for k, i, d in refs:
        if norm(i) and d is not None:
            past = [(x, 0) for j, x in parents if norm(j) == norm(i) and x is not None and x <= d] + [(x, 1) for j, x in gone if norm(j) == norm(i) and x is not None and x <= d]
            if not past or max(past)[1] == 1:
                out.append(k)
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pick = lambda: rng.choice([None, "", " \t", *[rng.choice([x, x.upper(), f" {x}\n"]) for x in ("a", "b", "c", "d")]])
    when = lambda: rng.choice([None, *range(0, 400, 7)])
    parents, gone = [(pick(), when()) for _ in range(30)], [(pick(), when()) for _ in range(15)]
    refs = [(k, pick(), when()) for k in range(300)] + [(k, "hot", 5 * k) for k in range(300, 340)]
    parents += [("hot", 800), ("a", 14), ("a", 14)]
    got = sorted(r["ref_seq"] for r in orphan_references(*sources(spark, parents, gone, refs)).collect())
    assert got == brute(parents, gone, refs)


def test_ties_and_counts(spark):
    parents, gone = [("a", 0), ("a", 100)], [("a", 50), ("b", None)]
    refs = [(1, "a", 0), (2, "a", 50), (3, "a", 49), (4, "b", 60), (5, "a", 120)]
    args = sources(spark, parents, gone, refs)
    assert sorted(r["ref_seq"] for r in orphan_references(*args).collect()) == [2, 4]
    counts = {r["period"]: (r["orphans"], r["open_at_end"]) for r in orphan_counts(*args).collect()}
    assert counts == {"2024-01": (0, 0), "2024-02": (1, 3), "2024-03": (1, 4), "2024-04": (0, 1), "2024-05": (0, 1)}


@pytest.mark.parametrize("late", [False, True])
def test_the_ledger_says_what_one_pass_would(spark, tmp_path, late):
    rng = random.Random(9)
    ids = ("a", "b", "c", " D\n", None)
    parents, gone = ([(rng.choice(ids), rng.choice([None, *range(0, 400, 9)])) for _ in range(n)] for n in (24, 14))
    refs = [(k, rng.choice(ids), rng.choice([None, *range(0, 400, 5)])) for k in range(150)]
    when = lambda r: rng.randrange(4) if late else min(3, (r[-1] or 0) // 100)
    step = [[(r, when(r)) for r in rows] for rows in (parents, gone, refs)]
    for n in range(4):
        OrphanLedger(spark, str(tmp_path)).advance(*sources(spark, *[[r for r, at in rows if at == n] for rows in step]))
    ledger, whole = OrphanLedger(spark, str(tmp_path)), sources(spark, parents, gone, refs)
    assert sorted(r["ref_seq"] for r in ledger.orphans().collect()) == brute(parents, gone, refs)
    assert sorted(map(tuple, ledger.counts().collect())) == sorted(map(tuple, orphan_counts(*whole).collect()))


def test_a_late_parent_takes_back_an_orphan(spark, tmp_path):
    ledger = OrphanLedger(spark, str(tmp_path))
    ledger.advance(*sources(spark, [], [], [(1, "a", 5), (2, "b", 5)]))
    ledger.advance(*sources(spark, [("a", 1)], [], []))
    assert [r["ref_seq"] for r in ledger.orphans().collect()] == [2]
    assert {r["period"]: (r["orphans"], r["open_at_end"]) for r in ledger.counts().collect()} == {"2024-01": (1, 1)}


def test_a_step_that_broke_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    ledger = OrphanLedger(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(ledger.folder, "write", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.advance(*sources(spark, [("a", 1)], [], [(1, "b", 5)]))
    assert ledger.orphans().isEmpty() and ledger.counts().isEmpty()


def test_empty_tables(spark):
    args = sources(spark, [], [], [])
    assert orphan_references(*args).count() == 0 and orphan_counts(*args).count() == 0
    refs, parents, _ = sources(spark, [], [], [(1, "a", 1)])
    assert [r["ref_seq"] for r in orphan_references(refs, parents).collect()] == [1]


def test_stream_keeps_state_between_batches(spark, tmp_path):
    schema = "id string, t timestamp, kind string, ref_table string"
    steps = [
        [("a", day(0), "reference", "t"), ("a", day(1), "reference", "t"), ("b", day(0), "arrival", None), ("b", day(2), "reference", "s")],
        [("a", day(40), "arrival", None), (None, day(3), "reference", "t")],
        [("a", day(50), "deletion", None), ("a", day(51), "reference", "t")],
    ]
    for n, rows in enumerate(steps):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        q = track(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    out = sorted((r["id"], r["period"], r["change"], r["references"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert out == [("a", "2024-01", "orphan", 1), ("a", "2024-01", "orphan", 1), ("a", "2024-01", "reopened", 2), ("a", "2024-01", "resolved", 2), ("a", "2024-03", "orphan", 1)]
