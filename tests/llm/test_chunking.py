import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm.chunking import split, split_oversized


def check(text, limit, overlap):
    cuts = split(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in cuts)
    if text:
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (s0, e0), (s1, e1) in zip(cuts, cuts[1:]):
        assert s0 < s1 <= e0 < e1 and e0 - s1 <= overlap
    rebuilt, at = "", 0
    for s, e in cuts:
        rebuilt, at = rebuilt + text[at:e], e
    assert rebuilt == text
    return cuts


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n!é漢́‍", max_size=400), st.integers(20, 80))
def test_pieces_cover_the_text(text, limit):
    check(text, limit, limit // 5)


def test_cuts_at_sentences_and_topics():
    rng = random.Random(5)
    cats = [" ".join(rng.choices(["feline", "whisker", "kitten", "purring"], k=8)) + ". " for _ in range(12)]
    cars = [" ".join(rng.choices(["engine", "gearbox", "wheel", "brake"], k=8)) + ". " for _ in range(12)]
    text = "".join(cats + cars)
    turn = len("".join(cats))
    cuts = check(text, turn + 100, 0)
    assert cuts[0][1] == turn


def test_text_without_boundaries_is_cut_hard():
    check("x" * 10_000, 2000, 200)
    check(("word " * 3000).strip(), 2000, 200)
    check("a" * 1999 + "é" * 900, 2000, 200)


def sentence(rng, length):
    words = ""
    while len(words) < length:
        words += rng.choice(["signal", "graph", "of", "sparse", "evidence", "in", "trial"]) + " "
    return words[: length - 2].rstrip().ljust(length - 2, "s") + ". "


def test_sentences_within_the_limit_are_never_cut():
    rng = random.Random(7)
    for low, high in ((600, 1900), (900, 900), (1900, 1900), (1100, 1300)):
        sentences = [sentence(rng, rng.randrange(low, high + 1)) for _ in range(14)]
        text = "".join(sentences)
        ends, at = set(), 0
        for x in sentences:
            at += len(x)
            ends.add(at)
        cuts = check(text, 2000, 200)
        assert {e for _, e in cuts} <= ends, (low, high)
        for (_, e), (s, _) in zip(cuts, cuts[1:]):
            fits = min(x for x in ends if x > e) - e + 200 <= 2000 if e < len(text) else True
            assert e - s >= (100 if fits else 0)


def test_boundary_classes_in_their_order():
    words = "alpha beta gamma " * 60
    paragraph = words[:1100].rstrip() + ".\n\n" + words[:400].rstrip() + ". " + words + words
    assert paragraph[: split(paragraph)[0][1]].endswith("\n\n")
    clause = words[:1200].rstrip() + ", " + words * 3
    assert clause[: split(clause)[0][1]].endswith(", ")
    assert split(words * 4)[0][1] > 1000 and (words * 4)[split(words * 4)[0][1] - 1] == " "


def test_overlap_in_text_without_blanks():
    ideographs = "".join(chr(0x4E00 + (i * 7919) % 5000) for i in range(6000))
    assert all(e - s == 200 for (_, e), (s, _) in zip(check(ideographs, 2000, 200), split(ideographs)[1:]))
    sentences = "".join(ideographs[i : i + 300] + "。" for i in range(0, 6000, 300))
    cuts = check(sentences, 2000, 200)
    assert all(sentences[e - 1] == "。" for _, e in cuts) and all(e - s >= 100 for (_, e), (s, _) in zip(cuts, cuts[1:]))
    check("e\u0301" * 3000, 2000, 200)


def test_operator(spark):
    long = "One two three. " * 400
    rows = [(1, None, "a"), (2, "", "a"), (3, "short", "a"), (4, "y" * 2000, "a"), (5, "y" * 2001, "a"), (6, long, "b"), (6, long, "b"), (None, long, "c")]
    df = spark.createDataFrame(rows, "seq int, abstract string, piece string")
    out = split_oversized(df, "abstract", "seq").collect()
    assert {r["seq"] for r in out} == {5, 6, None}
    assert all(len(r["piece"]) <= 2000 and r["piece_no"] < r["n_pieces"] for r in out)
    texts = {5: "y" * 2001, 6: long, None: long}
    assert all(texts[r["seq"]][r["start"] : r["end"]] == r["piece"] for r in out)
    assert sum(r["piece_no"] == 0 for r in out) == 4
    assert split_oversized(df.limit(0), "abstract", "seq").collect() == []
