"""Problem 6: encoding and decoding."""

import random

import pytest
from pyspark.sql import functions as F

from codekin.llm.encoding import _tokenizer, decoded, encoded, pieces, tokenizer_path

SCHEMA = "doc_id long, text string, chunk long, places string, words string"
PATH = tokenizer_path()
HARD = [
    "", None, " ", "\n\n \t x", "don't we'll I'M 'sx", "a  b   c", "  lead", "trail  ", "x y  z\u0085", "<|endoftext|> a<|endoftext|>",
    "naïve Ünïcödé ß 二進 ２１ ½ ²", "🙂👩‍👩‍👧 é", "a​b﻿c­", "0x82664e6 key_split_edge() ~>!!==", "\r\n\r\n\ta\r", "\x00\x1c\x1d", "एक दो", "a" * 5000, "1" * 3000, " " * 3000, "Ⅷ①٣",
]


def check(spark, texts, **options):
    df = spark.createDataFrame([(i, t, 1, "c", "d") for i, t in enumerate(texts)], SCHEMA)
    tokenizer = _tokenizer(PATH)
    ids = encoded(df, "doc_id", "text", PATH, **options)
    got = {r["doc_id"]: r["ids"] for r in ids.collect()}
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text"] for r in decoded(ids, PATH).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_hard_texts(spark):
    check(spark, HARD)


def test_random_texts_in_small_chunks(spark):
    rng = random.Random(4)
    alphabet = "ab 'sdé \n\t12%_-二🙂́"
    check(spark, ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)], chunk_words=50)


def test_long_text(spark):
    check(spark, ["word and 12 more, " * 100_000, "x"], chunk_words=1000)


def test_more_words_than_fit_two_bytes(spark):
    check(spark, [" ".join(f"w{i}q{i * 7}" for i in range(60_000))])


def test_empty_table_nulls_and_repeated_ids(spark):
    assert encoded(spark.createDataFrame([], SCHEMA), "doc_id", "text", PATH).count() == 0
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)], "doc_id long, text string")
    rows = sorted(((r["doc_id"] or 0, len(r["ids"])) for r in encoded(df, "doc_id", "text", PATH).collect()))
    assert rows == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert [r["text"] for r in decoded(df.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), PATH).distinct().collect().__iter__()] == [""] * 3


def test_pieces_are_the_vocabulary():
    table = pieces(PATH)
    assert len(table) == 50257 and table[50256] == b"<|endoftext|>" and b"".join(table[i] for i in _tokenizer(PATH).encode("é 二").ids).decode() == "é 二"


@pytest.mark.parametrize("name", ["no_such_file.json"])
def test_missing_vocabulary_fails(name):
    with pytest.raises(Exception):  # noqa: B017
        _tokenizer(tokenizer_path(name))
