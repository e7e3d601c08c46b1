"""SentencePiece ids and texts against the library, against merges one by one, and on the columns of a table."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from varve.llm import queries, sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
EDGES = ["", " ", "   a", "a   ", "\n\n\t x\r\n", "▁a ▁", "<0x41><s></s><unk>", "\0", "�", "😀👍🏽", "é" * 50, "日本語 テスト", "-" * 700, "=-" * 300, "#" * 33 + "a"]
EDGES += [" " * n for n in range(2, 70)] + ["a" * n for n in range(1, 70)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _fuzz(n: int) -> list[str]:
    pick = random.Random(5)
    wide = lambda: "".join(chr(pick.choice([pick.randrange(32, 127), pick.randrange(128, 0x3100), pick.randrange(0x10000, 0x11000)])) for _ in range(8))
    pools = ["aeiou tnrs \n\t▁  .,;(){}=\r", "ab", " ▁a", "0123456789 ", "héßüç ñ", "日本語中文 "]
    out = []
    for _ in range(n):
        pool = pick.choice(pools) if pick.random() < 0.6 else wide()
        out.append("".join(pick.choice(pool) for _ in range(pick.randrange(40))))
    return out


def test_ids_and_texts_equal_the_library(library):
    model = sentence_pieces.load(PATH)
    for text in EDGES + _fuzz(4000):
        ids = library.encode(text)
        assert model.encode(text) == ids, text
        assert model.decode(ids) == library.decode(ids), text


def test_any_ids_decode_as_in_the_library(library):
    model, pick = sentence_pieces.load(PATH), random.Random(6)
    for _ in range(4000):
        ids = [pick.choice([pick.randrange(3), pick.randrange(3, 259), pick.randrange(259, 32000)]) for _ in range(pick.randrange(8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_words_merged_together_equal_words_merged_alone():
    model = sentence_pieces.load(PATH)
    words = [w for t in _fuzz(300) for w in model.cut(t)]
    assert model.encode_words(words) == [model.encode_words([w])[0] for w in words]


def test_long_runs_and_words(library):
    model, pick = sentence_pieces.load(PATH), random.Random(7)
    for text in (" " * 60_000 + "x", "".join(pick.choice("abcdefgh") for _ in range(20_000)), "ab" * 30_000):
        assert model.encode(text) == library.encode(text)


def test_columns_with_nulls_and_other_columns(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "Two  words", 0), (3, "Two  words", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoder = sentence_pieces.PieceEncoder(PATH)
    found = docs.select("doc_id", encoder.token_ids(F.col("text")).alias("ids"), encoder.digest(F.col("text")).alias("d"))
    found = found.withColumn("back", encoder.text_of(F.col("ids"))).collect()
    assert [(r.doc_id, r.back) for r in found] == [(1, ""), (2, ""), (3, "Two  words"), (3, "Two  words")]
    empty = hashlib.sha256(b"").hexdigest()
    assert tuple(found[0].d) == tuple(found[1].d) == (0, empty, empty)
    assert docs.limit(0).select(encoder.digest(F.col("text"))).collect() == []


def test_query_equals_the_library(spark, sf, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for doc_id, text in texts.items():
        ids = library.encode(text)
        want[doc_id] = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
    got = queries.QUERIES["op12_sentence_pieces"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want
