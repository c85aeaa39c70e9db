import random
from itertools import combinations

import numpy as np
import pytest

from lacuna.llm import gear
from lacuna.llm.spans import SharedSpans


def texts(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop\né漢") for _ in range(n))
    shared = [fresh(n) for n in (199, 200, 201, 230, 400, 900)]
    plate = fresh(150)
    out = []
    for i in range(60):
        t = fresh(rng.randrange(0, 500))
        if i % 3 == 0:
            t += rng.choice(shared) + fresh(rng.randrange(0, 200))
        if i % 2:
            t += plate + fresh(rng.randrange(0, 100))
        out.append(t)
    run = "=" * 260
    out += [run, "x" + run, run[:199], "ab" * 150, "ab" * 130 + "c", out[0], out[0], out[3], "", None, fresh(5000) + shared[3] + fresh(3000)]
    return list(enumerate(out))


def brute(rows, span=200):
    own = {k: {t[i : i + span] for i in range(len(t) - span + 1)} for k, t in rows if k is not None and t and len(t) >= span}
    return {(a, b) for a, b in combinations(sorted(own), 2) if own[a] & own[b]}, own


@pytest.mark.parametrize(("seed", "large"), [(1, 64), (2, 3), (3, 1)])
def test_pairs_and_coverage_match_brute_force(spark, seed, large):
    rows = texts(seed)
    df = spark.createDataFrame([*((k, t, "d", 1) for k, t in rows), (None, "n" * 300, "d", 1)], "doc_id bigint, text string, doc string, n int")
    s = SharedSpans(df, "doc_id", "text", 200, large)
    got = [tuple(r) for r in s.pairs().collect()]
    want, own = brute(rows)
    assert len(got) == len(set(got)) and set(got) == want
    cover = {r["doc"]: r["shared_chars"] for r in s.coverage().collect()}
    whole = {}
    for k, t in rows:
        if k in own:
            marks = np.zeros(len(t), bool)
            others = set().union(*(o for j, o in own.items() if j != k))
            for i in range(len(t) - 199):
                if t[i : i + 200] in others:
                    marks[i : i + 200] = True
            whole[k] = int(marks.sum())
    assert cover == whole


def test_every_shared_span_holds_a_common_chunk():
    rng = random.Random(9)
    window, least = gear.sizes_for(200)
    assert gear.GEAR - 1 + 2 * window + least <= 201
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcdefgh ", "aaaaab", "0123456789abcdef"])
        fresh = lambda n: "".join(rng.choice(alphabet) for _ in range(n))  # noqa: B023, E731
        core = fresh(200)
        pair = [fresh(rng.randrange(0, 300)) + core + fresh(rng.randrange(0, 300)) for _ in range(2)]
        digest, row, _, size = gear.chunks(*gear.code_points(pair), window, least)
        assert set(digest[row == 0]) & set(digest[row == 1])
        assert size.min() >= least


def test_empty_table(spark):
    s = SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text")
    assert s.pairs().count() == 0 and s.coverage().count() == 0


def test_a_line_in_every_text_is_no_task_of_its_own(spark):
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    plate = fresh(260)
    rows = [(i, fresh(100) + plate + fresh(150)) for i in range(400)] + [(400 + i, fresh(300)) for i in range(5)]
    s = SharedSpans(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert s.pairs().count() == 400 * 399 // 2
    assert "Window" not in s.by_stretch._jdf.queryExecution().toString()
    cover = {r["doc"]: r["shared_chars"] for r in s.coverage().collect()}
    assert all(cover[i] >= 260 for i in range(400)) and not any(cover[400 + i] for i in range(5))


def test_two_hashes_that_meet_by_chance_make_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("abcdefghij klmnop") for _ in range(n))
    core = fresh(400)
    s = SharedSpans(spark.createDataFrame([(1, core + fresh(90)), (2, fresh(70) + core), (3, fresh(500)), (4, fresh(500))], "doc_id bigint, text string"), "doc_id", "text")
    s.candidates = s.candidates.unionByName(spark.createDataFrame([(3, 4, 250, 10, 0)], "a bigint, b bigint, best bigint, lo bigint, shift bigint"))
    assert [tuple(r) for r in s.rep_pairs().collect()] == [(1, 2)]
