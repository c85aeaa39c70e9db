import random
import re
from itertools import combinations

import numpy as np
import pytest

from lacuna.llm import shingles as S
from lacuna.llm import vptree as V

WORD = re.compile(r"[^\W_]+")


def sets_of(rows, k, least=20):
    out = {}
    for key, a, b in rows:
        w = WORD.findall(((a or "") + " " + (b or "")).lower())
        if key is not None and len(w) >= least:
            out[key] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return out


def brute(rows, t, k):
    s = sets_of(rows, k)
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= t - 1e-12}


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 0
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randrange(15, 90))
        for _ in range(rng.choice([1, 1, 2, 4])):
            edited = list(words)
            for _ in range(rng.randrange(0, 6)):
                p = rng.randrange(len(edited))
                edited[p : p + rng.choice([0, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1]))
            key += 1
            rows.append((key, " ".join(edited[:5]), " ".join(edited[5:])))
    rows += [(key + 1, None, None), (key + 2, "", ""), (None, "x", "y"), (key + 3, None, "Same " * 30), (key + 4, "same", "same " * 40), (key + 5, "long", " ".join(rng.choices(vocabulary, k=20000)))]
    return rows


@pytest.mark.parametrize(("seed", "t", "k", "large"), [(1, 0.7, 3, 20000), (2, 0.8, 5, 20000), (3, 0.7, 3, 1)])
def test_pairs_match_brute_force(spark, seed, t, k, large):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "seq bigint, title string, abstract string, key int, t0 int")
    pairs, same = V.near_duplicates(df, "seq", ["title", "abstract"], t, k, 20, large)
    got = [tuple(r) for r in V.expanded(pairs, same).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, t, k)


def test_cut_shards_find_the_same_pairs():
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 200, 60)]
        texts += [" ".join(words), " ".join(words[:-3])]
    s, ends = S.shingle_sets(texts, 3, 20)
    fp = S.odd_sketch(s, ends)
    count = np.bincount(S.slot(s, 1 << 21), minlength=1 << 21)
    p, row, pos, n = S.ranked_prefixes(s, ends, count, 0.7)

    def found(large):
        at, cell, side = V._shards(p, row, n, pos, fp, count[S.slot(p, 1 << 21)], large, 0.7)
        order = np.argsort(cell, kind="stable")
        at, cell, side = at[order], cell[order], side[order]
        i, j = V.pairs_in_shards(cell, n[row[at]], pos[at], side, fp[row[at]], 0.7)
        return {tuple(sorted((int(row[at[a]]), int(row[at[b]])))) for a, b in zip(i, j) if row[at[a]] != row[at[b]]}

    assert found(10**6) == found(1) == found(3) and len(found(1)) >= 40


def test_texts_from_a_template_do_not_meet_over_it():
    template = [f"w{i}" for i in range(90)]
    texts = [" ".join([*template, *(f"own{r} {i}" for i in range(12))]) for r in range(300)]
    s, ends = S.shingle_sets(texts, 3, 20)
    count = np.bincount(S.slot(s, 1 << 21), minlength=1 << 21)
    p, row, pos, n = S.ranked_prefixes(s, ends, count, 0.7)
    at, _, side = V._shards(p, row, n, pos, S.odd_sketch(s, ends), count[S.slot(p, 1 << 21)], 50, 0.7)
    assert (side == 1).any() and not (side == 0).any()


@pytest.mark.parametrize("spread", [4, 64])
def test_tree_finds_all_within_radius(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, (20, 2)).astype(np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 2)).astype(np.uint64)
    prints = base[rng.integers(0, 20, 400)] ^ np.where(rng.random((400, 2)) < 0.5, flips, np.uint64(0))
    radii = rng.integers(0, spread, 400)
    q, i = V.Tree(prints).within(prints, radii)
    d = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1)
    assert sorted(zip(q, i)) == sorted(zip(*np.nonzero(d <= radii[:, None])))


def test_odd_sketch_never_overstates():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        fp = S.odd_sketch(np.concatenate((a, b)), np.array([len(a), len(a) + len(b)]))
        assert V.hamming(fp[0], fp[1]) <= len(np.setxor1d(a, b))


def test_empty_table(spark):
    df = spark.createDataFrame([], "seq bigint, title string, abstract string")
    pairs, same = V.near_duplicates(df, "seq", ["title", "abstract"])
    assert pairs.count() == 0 and same.count() == 0 and V.expanded(pairs, same).count() == 0
