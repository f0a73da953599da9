"""Encoding and decoding beside the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer as Library

from tests.llm.helpers import documents
from weekcast.llm.bpe import Tokenizer, encode_texts, read_vocabulary, token_digests
from weekcast.llm.queries import op3_bpe, vocabulary_path


@pytest.fixture(scope="module")
def both():
    path = vocabulary_path()
    return Tokenizer(read_vocabulary(path)), Library.from_file(path)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def as_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def texts():
    draw = random.Random(3)
    signs = [chr(c) for c in range(0x250)] + list(" 　中́﻿​😀ſK")
    words = ["<|endoftext|>", "a", " ", "<|", "the", " ing", "aaaa", "    ", "====", "\n\n", "'s", "'S", "123"]
    yield from ("", " ", "\n", "aaa" * 2000, "ab" * 3000, " " * 5000, "x" * 20000)
    for _ in range(400):
        yield "".join(draw.choice(signs) for _ in range(draw.randint(1, 50)))
        yield "".join(draw.choice(words) for _ in range(draw.randint(1, 30)))
        yield "".join(draw.choice("abcdeth  ns") for _ in range(draw.randint(1, 60)))


def test_same_ids_and_text_as_library(both):
    coder, library = both
    for text in texts():
        ids = ids_of(library, text)
        assert coder.encode(text) == as_bytes(ids), text[:80]
        assert coder.decode(as_bytes(ids)) == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_broken_bytes(both):
    coder, library = both
    for ids in ([0xE2 % 200, 120, 130], [161, 162, 163], [50256, 10, 200, 100]):
        assert coder.decode(as_bytes(ids)) == library.decode(ids, skip_special_tokens=False)


def test_query_matches_library(spark, folder, both):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: r for r in op3_bpe(spark, folder).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        ids = ids_of(both[1], text or "")
        row = found[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(as_bytes(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = documents(spark, [(1, None), (1, None), (None, "a b"), (3, "")], ["text AS n_tokens", "'x' AS ids", "lang AS id"])
    out = encode_texts(rows, vocabulary_path()).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.decoded) for r in out) == [
        (False, 1, 0, ""), (False, 1, 0, ""), (False, 3, 0, ""), (True, 0, 2, "a b"),
    ]
    assert token_digests(rows, vocabulary_path()).count() == 4
