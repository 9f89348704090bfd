"""Encoding, spans, decoding."""

import pytest
from tokenizers import Tokenizer

from tamarisk.llm import tokens

TEXTS = ["", None, " ", "\n\n", "Hello world", "<|endoftext|> x", "naïve café ☕ 👩‍👩‍👧", "日本語テキスト", "a" * 20_000, "\u0000\u0001﻿", "é", "\r\n\t x", "नमस्ते"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "Hello world", "y")], "doc_id bigint, text string, ids string")


def test_ids_match_the_library(frame):
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(frame).collect()}
    assert len(got) == len(TEXTS) + 1 and got[None] == got[4]
    for i, x in enumerate(TEXTS):
        assert got[i] == (t.encode(x, add_special_tokens=False).ids if x else [])


def test_round_trip_and_spans(frame):
    enc = tokens.encode_corpus(frame)
    back = {r.doc_id: r.text for r in tokens.decode_corpus(enc).collect()}
    spans = {r.doc_id: list(zip(r.starts, r.ends)) for r in tokens.token_spans(enc).collect()}
    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for i, x in enumerate(TEXTS):
        assert back[i] == (x or "")
        assert spans[i] == [tuple(o) for o in t.encode(x or "", add_special_tokens=False).offsets]


def test_cut_lists_show_broken_characters(spark):
    ids = tokens.encode_corpus(spark.createDataFrame([(1, "👩")], "doc_id bigint, text string")).first().ids
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids[:-1]), (2, None)], "doc_id bigint, ids array<int>")
    got = {r.doc_id: r.text for r in tokens.decode_corpus(cut).collect()}
    assert "�" in got[1] and got[2] == ""


def test_counts_and_empty(spark, frame):
    c = {r.doc_id: r.tokens for r in tokens.token_counts(frame, ["byte_bpe_50k"]).collect()}
    assert c[0] == c[1] == 0 and c[4] == 2
    assert tokens.encode_corpus(frame.limit(0)).count() == 0


def test_byte_table_is_one_to_one():
    assert len(set(tokens.byte_characters())) == 256
