import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_near_duplicates import corpus, sets_of

from lacuna.llm import history
from lacuna.llm import shingles as S
from lacuna.llm.history import Index, screen

TEXTS = ["title", "abstract"]


def batches(seed):
    rng = random.Random(seed)
    rows = []
    for key, a, b in corpus(seed, 40):
        rows.append((key, rng.choice([0, 0, 1, 2, 3]), rng.choice([None, None, f"id{rng.randrange(25)}", f"u{key}"]), a, b))
    return rows


def sequential(rows, t, k):
    sets = sets_of([(r[0], r[3], r[4]) for r in rows], k)
    taken, ids, out = [], set(), {}
    for key, batch, name, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1], r[0])):
        mine = sets.get(key)
        like = mine is not None and any(len(mine & o) / len(mine | o) >= t - 1e-12 for o in taken)
        out[key] = not (like or (name is not None and name in ids))
        if out[key]:
            taken += [mine] if mine is not None else []
            ids.add(name)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "seq bigint, batch int, pid string, title string, abstract string, cls string, ord string")


def result(df):
    return {r["seq"]: r["accepted"] for r in df.collect()}


@pytest.mark.parametrize("seed", [11, 12])
def test_one_append_matches_the_sequential_rule(spark, seed):
    rows = batches(seed)
    assert result(screen(frame(spark, rows), "seq", "pid", TEXTS, [F.col("batch")], 0.7, 3)) == sequential(rows, 0.7, 3)


def test_batch_by_batch_matches_too_with_an_index_opened_anew_each_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "GROW", 1.5)  # the order is fixed anew on the way
    rows = batches(13)
    got, generations = {}, set()
    for b in range(4):
        index = Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3)
        got |= result(index.add(frame(spark, [r for r in rows if r[1] == b]), "seq", [F.col("batch")]))
        generations.add(index.commits()[-1][1])
    assert got == sequential(rows, 0.7, 3) and len(generations) > 1


def test_an_index_opened_at_its_folder_knows_what_it_holds(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3).add(frame(spark, [(1, 0, "a", text, "")]), "seq", [F.col("batch")])
    again = Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3)
    assert result(again.add(frame(spark, [(2, 1, "b", "x " + text, ""), (3, 1, "a", None, None), (4, 1, "c", None, None)]), "seq", [F.col("batch")])) == {2: False, 3: False, 4: True}
    with pytest.raises(ValueError):
        Index(spark, str(tmp_path), TEXTS, "pid", 0.8, 3)


def test_a_batch_that_broke_off_leaves_no_trace(spark, tmp_path, monkeypatch):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3).add(frame(spark, [(1, 0, "a", text("w"), "")]), "seq", [F.col("batch")])
    with monkeypatch.context() as m:
        m.setattr(Index, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3).add(frame(spark, [(2, 1, "b", text("v"), "")]), "seq", [F.col("batch")])
    index = Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3)
    assert len(index.commits()) == 1
    assert result(index.add(frame(spark, [(3, 1, "b", text("v"), ""), (4, 1, "c", text("w"), "")]), "seq", [F.col("batch")])) == {3: True, 4: False}


def test_a_second_writer_of_a_batch_fails(spark, tmp_path):
    index = Index(spark, str(tmp_path), TEXTS, "pid", 0.7, 3)
    index._commit(0, "p", "g", 1)
    with pytest.raises(RuntimeError):
        index._commit(0, "q", "g", 1)
    assert index.commits() == [("p", "g", 1)]


@pytest.mark.parametrize("most", [3, 20])
def test_a_full_segment_takes_the_batch_in_stretches(spark, most):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 3, 9])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, rng.randrange(3), rng.choice([None, f"id{rng.randrange(40)}"]), " ".join(words), None))
    rows += [(100 + i, 1, None, " ".join(base), None) for i in range(10)]
    assert result(screen(frame(spark, rows), "seq", "pid", TEXTS, [F.col("batch")], 0.7, 3, most=most)) == sequential(rows, 0.7, 3)


def test_meetings_hold_every_pair_of_a_likeness(monkeypatch):
    rng = random.Random(6)
    sets = [set(rng.sample(range(80), rng.randrange(20, 60))) for _ in range(40)]
    sets += [set(list(s)[3:]) | {200 + i} for i, s in enumerate(sets)]
    hashes = S.mix(np.arange(300, dtype=np.uint64)) >> np.uint64(24) << np.uint64(24)
    flat = np.concatenate([np.sort(hashes[list(s)]) for s in sets])
    s, row, pos, n = S.ranked_prefixes(flat, np.cumsum([len(x) for x in sets]), np.bincount(S.slot(flat, 4096), minlength=4096), 0.7)
    old = row % 3 == 0
    meta = n[row] << 32 | pos | np.where(old, history._OLD, 0)
    at = np.argsort(s, kind="stable")
    for leaf in (1, 16):
        monkeypatch.setattr(history, "LEAF", leaf)
        i, j, full = history.meetings(s[at].view(np.int64), row[at], meta[at], 0.7)
        got = {frozenset((row[at][x], row[at][y])) for x, y in zip(i, j)}
        want = {frozenset((x, y)) for x in range(len(sets)) for y in range(x) if (x % 3 or y % 3) and len(sets[x] & sets[y]) / len(sets[x] | sets[y]) >= 0.7}
        assert want and want <= got and not len(full)


def test_many_copies_of_one_id_and_text(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(i, 0, "one", None, None) for i in range(50)] + [(i, 0, None, text, "") for i in range(50, 100)]
    assert {k for k, v in result(screen(frame(spark, rows), "seq", "pid", TEXTS, [F.col("batch")], 0.7, 3)).items() if v} == {0, 50}


def test_empty_batch(spark):
    assert result(screen(frame(spark, []), "seq", "pid", TEXTS, [F.col("batch")])) == {}
