"""Corpus pipeline: from raw documents to token digests, each stage by one operator of ``varve.llm``.

Every stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``;
the last returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import byte_bpe, decontaminate, line_dedup, near_dedup, pairwise_quality
from varve.operators.staging import Workspace

#: Fitting, banding and union-find have no SQL twin; the stages are tested against brute force.
ORACLE_SQL = None

#: Bytes of texts that Spark hands to a Python worker at a time: by their number alone, batches grow with the texts.
BATCH_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes for this session, unless it has a bound of its own; rows are only cut into batches otherwise."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise quality classifier accepts; null and empty texts are scored like all others."""
    _bound_batches(spark)
    model = pairwise_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.withColumn("score_", model.score(F.col("text")))
    return scored.where(F.col("score_") >= pairwise_quality.ACCEPT).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal or resemble an earlier line; documents left without a word go, n_chars follows the text."""
    _bound_batches(spark)
    has_words = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "", F.lit(False))
    cleaned = line_dedup.drop_lines(docs.withColumn("had_words_", has_words), line_dedup.mark_duplicates(docs, line_dedup.WHOLE))
    return cleaned.where(has_words | ~F.col("had_words_")).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five words, similarity of 0.8): the smallest id. Rows with a null id stay."""
    _bound_batches(spark)
    judged = near_dedup.near_duplicates(docs, near_dedup.NearDedup(percent=80))
    kept = judged.where("kept and doc_id is not null").select("doc_id").distinct()
    chosen = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    # Of rows with the same id the first by its columns in their order stays.
    chosen = chosen.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("row"))
    return chosen.select("doc_id", "row.*").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    _bound_batches(spark)
    pairs = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.judge(docs, pairs).where("kept").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the byte-level BPE ids of every text and of the bytes they decode to."""
    _bound_batches(spark)
    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return docs.select("doc_id", bpe.digest(F.col("text")).alias("d")).select("doc_id", "d.*")


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
