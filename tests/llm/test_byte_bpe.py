from __future__ import annotations

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from corvane.llm.byte_bpe import Codec, byte_bpe

from .helpers import empty, odd


@pytest.fixture(scope="module")
def codec():
    return Codec.load(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library(codec, library):
    rng = random.Random(4)
    parts = ["the", " ", "  ", "\n", "\t", "'s", "’s", "12", "é", "日本", "😀", "%%%", "don't", " ", " ", "\x1c", "<|endoftext|>", "a" * 50, ".", "!!"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(200)))
        assert codec.encode(text) == library.encode_ordinary(text)


def test_long_texts_are_presplit(codec, library, monkeypatch):
    from corvane.llm import byte_bpe as module

    rng = random.Random(5)
    words = ["word", "x1", "end.", "a,", "it's", "été", "\n\n", "  ", "\t", "--", "42"]
    text = " ".join(rng.choice(words) for _ in range(30_000))
    whole = library.encode_ordinary(text)
    for size in (10, 100, 1000, 100_000):
        monkeypatch.setattr(module, "PIECE", size)
        assert "".join(codec.pieces(text)) == text
        assert codec.encode(text) == whole


@pytest.mark.parametrize("text", [" " * 300_000 + "x", "\n" * 300_000, "a" * 300_000, "é" * 200_000, "%" * 200_000, "1" * 200_000, " " * 1_500_000 + "end", "x" + " \n" * 400_000 + "y z"])
def test_very_long_runs(codec, text):
    assert codec.decode(codec.encode(text)) == text.encode()


def test_blank_runs_as_the_library_would(codec, library):
    for text in ("a" + " " * 25_000 + "b c", "a" + "\n" * 21_000, " " * 30_000 + "\t x"):
        assert codec.encode(text) == library.encode_ordinary(text)


def test_round_trip_of_odd_rows(spark):
    got = byte_bpe(odd(spark)).collect()
    want = sorted((str(r.doc_id), (r.text or "").encode()) for r in odd(spark).collect())
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == want
    assert all(len(r.ids) == 0 for r in got if r.doc_id in (3, 4, 99))


def test_invalid_utf8_is_replaced(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF62') AS string) AS text")
    assert bytes(byte_bpe(docs).first().decoded) == "a�b".encode()


def test_empty(spark):
    assert byte_bpe(empty(spark)).collect() == []
