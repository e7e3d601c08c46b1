"""The operators of this subpackage applied to their whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import byte_bpe, compression_langid, decontaminate, line_dedup, merkle, near_dedup, oracles, pairwise_quality, quality_rules, sentence_pieces, spelling, token_records, url_filter, warc

URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    edges = url_filter.equivalence_edges(pages)
    return url_filter.judge_urls(pages.select("page_id", "url"), edges, URL_RULES).drop("url")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_rules.ledger(quality_rules.measure(docs))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.passes(quality_rules.BASE)).alias("base_failed"),
        quality_rules.passes(quality_rules.POLICIES["v1"]).alias("kept"),
        "failures",
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.archive(_read(spark, sf_dir, "pages")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), near_dedup.NearDedup(percent=85))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pairwise_quality.measured(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    model = pairwise_quality.fit_measured(texts, _read(spark, sf_dir, "labels"))
    scored = texts.select(
        "doc_id", pairwise_quality.is_held_out(F.col("doc_id")).alias("held_out"), model.score_measured(F.col("f")).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= pairwise_quality.ACCEPT).cast("int"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = token_records.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    return token_records.read_documents(token_records.archive(_read(spark, sf_dir, "documents"), encoder))


def op7_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = pairwise_quality.is_held_out(F.col("doc_id"))
    model = compression_langid.fit(docs, ~held_out)
    return docs.select("doc_id", held_out.alias("held_out"), model.predict(F.col("text")).alias("p")).select("doc_id", "held_out", "p.*")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return _read(spark, sf_dir, "documents").select("doc_id", bpe.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.summary(docs, line_dedup.mark_duplicates(docs, line_dedup.WHOLE))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    pairs = decontaminate.contamination(docs, _read(spark, sf_dir, "benchmark"))
    return decontaminate.judge(docs.select("doc_id"), pairs)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of every document, and whether a third of the documents, tampered with, still folds to the root."""
    docs = _read(spark, sf_dir, "documents")
    return merkle.manifest(merkle.document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids of every document and of the text they decode to."""
    encoder = sentence_pieces.PieceEncoder(public_tokenizers.path("piece_bpe_32k.model"))
    return _read(spark, sf_dir, "documents").select("doc_id", encoder.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words' number, its form and the root that forms lead to."""
    p = spelling.Spelling()
    return spelling.variants(spelling.vocabulary(spelling.document_words(_read(spark, sf_dir, "documents")), p), p)


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_pairwise_quality": op5_pairwise_quality,
    "op6_token_records": op6_token_records,
    "op7_compression_langid": op7_compression_langid,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = oracles.ORACLES
