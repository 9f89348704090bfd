"""Problem 6: encoding of a whole corpus with a public byte-level BPE tokenizer, with offsets and exact decoding.

The tokenizer works on bytes shown as characters. The table between the two is built from its rule; with it a token's bytes,
and so its place in the text, follow from its id alone, and decoding joins the bytes of all tokens before it reads characters,
so that characters split between tokens come out whole.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Folder of the tokenizer files; a parameter of every operator.
TOKENIZERS = "/opt/tokenizers"
#: Characters that are encoded at once, unless one text is longer.
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str):
    """The tokenizer of a file; strings that look like special tokens are ordinary text to it."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


@lru_cache(maxsize=4)
def token_bytes(name: str, folder: str) -> list[bytes]:
    """The bytes of every id; an id without a token in the vocabulary has none."""
    with open(f"{folder}/{name}.json", encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    back = {c: b for b, c in enumerate(byte_characters())}
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in groups of about BATCH_CHARS characters; null is empty."""
    group, size = [], 0
    for t in texts:
        t = t or ""
        if group and size + len(t) > BATCH_CHARS:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def encode(texts: list[str | None], name: str, folder: str) -> Iterator[list[int]]:
    """The ids of each text in turn."""
    t = tokenizer(name, folder)
    for group in chunks(texts):
        for e in t.encode_batch_fast(group, add_special_tokens=False):
            yield e.ids


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``ids`` of every row of ``docs``, without special tokens.

    Null and empty texts have an empty list of ids, blank texts are encoded as they are, whole texts always. Rows with a null
    or repeated key are encoded like any other; other columns are left out. A narrow map over Arrow batches: no shuffle.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array(list(encode(b.column(1).to_pylist(), name, folder)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def spans(ids: list[int], table: list[bytes]) -> tuple[list[int], list[int]]:
    """First character and the one after the last of each token, counted from 0; a token with part of a character spans it whole."""
    if not ids:
        return [], []
    parts = [table[i] for i in ids]
    ends = np.cumsum([len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    starts = np.concatenate([[0], ends[:-1]])
    return char[starts].tolist(), (char[ends - 1] + 1).tolist()


def token_spans(encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key``, ``starts`` and ``ends``: the characters of each token, from the ids alone."""
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(name, folder)
        for b in batches:
            both = [spans(x or [], table) for x in b.column(1).to_pylist()]
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s for s, _ in both], lists), pa.array([e for _, e in both], lists)], [key, "starts", "ends"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, starts array<int>, ends array<int>")


def decode_corpus(encoded: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``text`` of every row of ids; no ids, or null, give an empty text.

    Bytes are joined over the whole list first; only bytes that form no character (a list cut inside one) become U+FFFD.
    """
    kind = dict(encoded.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(name, folder)
        for b in batches:
            texts = [b"".join([table[i] for i in x or []]).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def token_counts(docs: DataFrame, names: list[str], key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """``key``, ``tokenizer`` and ``tokens``, one row for each row of ``docs`` and tokenizer."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for n in names:
                size = pa.array([len(x) for x in encode(texts, n, folder)], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n] * len(texts), pa.string()), size], [key, "tokenizer", "tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokenizer string, tokens bigint")
