"""All labelled texts outside the held-out fold are learned from, however many there are."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.llm import pairwise_quality
from varve.operators import ordered


def test_every_label_is_used(spark, monkeypatch):
    """30,000 texts, of which the last by hash would be cut by a limit of 20,000."""
    seen = []
    positions = ordered.positions

    def watched(rows, *rest, **named):
        seen.append(rows.count())
        return positions(rows, *rest, **named)

    monkeypatch.setattr(ordered, "positions", watched)
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("buy now !!! $$$")).otherwise(F.lit("a plain line of words that go on")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    model = pairwise_quality.fit(docs, labels)
    assert set(seen) == {docs.where(~pairwise_quality.is_held_out(F.col("doc_id"))).count()} and seen[0] > 20_000
    got = docs.select("doc_id", model.score(F.col("text")).alias("score"))
    assert got.where((F.col("score") >= pairwise_quality.ACCEPT) != (F.col("doc_id") % 3 != 0)).count() == 0
    f = pairwise_quality.measured(docs).limit(50).select("doc_id", model.score_measured(F.col("f")).alias("other")).join(got, "doc_id")
    assert f.where("abs(score - other) > 1e-9").count() == 0


def test_quantiles_lie_between_values(spark):
    from varve.operators.staging import Workspace

    rows = spark.range(101).select((F.col("id") % 2).alias("label"), F.col("id").alias("place"), (F.col("id") * 2.0).alias("raw"))
    assert pairwise_quality._quantiles(rows, [0.0, 0.255, 1.0], 101, Workspace(spark, "test-quantiles")) == [0.0, 51.0, 200.0]
