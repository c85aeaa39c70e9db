import random

import public_tokenizers as P
import pytest
import tiktoken

from lacuna.llm import tokens as K

BLOB = K._read(P.path("byte_bpe_50k.tiktoken"))
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=K.ranks_of(BLOB), special_tokens={})


def test_same_ids_as_the_public_encoder():
    rng = random.Random(4)
    enc = K.encoder(BLOB, P.PATTERN)
    parts = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "漢字", "0", "12", "'s", "‍", "🙂", "﻿", "<|endoftext|>", "zz", "ß"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 80)))
        assert enc.encode(text) == REF.encode_ordinary(text), text


def test_long_run_without_breaks():
    text = "ab" * 20_000 + "a" * 30_001
    assert K.encode_piece(text.encode(), K.ranks_of(BLOB)) == REF.encode_ordinary(text)


@pytest.mark.parametrize("batch_chars", [1, 4_000_000])
def test_operator(spark, batch_chars, monkeypatch):
    monkeypatch.setattr(K, "_BATCH_CHARS", batch_chars)
    rows = [(1, "Hello world", "p"), (2, "", "p"), (3, None, "p"), (4, "Hello world", "p"), (4, "  ", "q"), (None, "x", "q")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"], r["ids"]) for r in K.encode_column(df, "text", "doc_id").collect()), key=str)
    want = sorted(((k, REF.encode_ordinary(t or "")) for k, t, _ in rows), key=str)
    assert got == want
    assert K.encode_column(df.limit(0), "text", "doc_id").collect() == []
    sizes = sorted(((r["doc_id"], r["n_tokens"]) for r in K.count_column(df, "text", ["doc_id"]).collect()), key=str)
    assert sizes == sorted(((k, len(i)) for k, i in want), key=str)
