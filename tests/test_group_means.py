"""Means of groups without the grid against the grid, and chunks of hidden states dealt to all tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import abundance, forests
from varve.operators import hidden_states as hs
from varve.operators.staging import Workspace
from varve.plans.state_queries import group_means
from varve.sources.domain import Domain


def test_group_means_are_those_of_the_grid(spark, sf):
    d = Domain(spark, sf.replace("sf0.001", "sf0.01"))
    grid = d.clr_primary.join(d.taxa.select("taxon", "functional_group"), "taxon").groupBy("label", "functional_group").agg(F.avg("clr").alias("v"))
    want = {(r.label, r.functional_group): r.v for r in grid.collect()}
    got = {(r.label, r.functional_group): r.v for r in group_means(d, Workspace(spark, "test")).collect()}
    assert len(want) > 100 and got.keys() == want.keys() and all(abs(got[k] - v) < 1e-10 for k, v in want.items())


def test_group_means_of_samples_and_groups_without_records(spark):
    totals = spark.createDataFrame([("a", 1, 2.0), ("b", 1, None), ("rare", 1, 9.0)], "taxon string, label long, abundance double")
    taxa = spark.createDataFrame([("a",), ("b",)], "taxon string")
    groups = spark.createDataFrame([("a", "g"), ("b", None), ("rare", "g")], "taxon string, functional_group string")
    samples = spark.createDataFrame([("c", 1), ("c", 2)], "core string, label long")
    found = {(r.label, r.functional_group): round(r.v, 9) for r in abundance.group_log_ratios(totals, taxa, samples, groups).collect()}
    assert found == {(1, "g"): round(0.5 * 1.6094379124341003, 9), (1, None): round(-0.5 * 1.6094379124341003, 9), (2, "g"): 0.0, (2, None): 0.0}
    assert abundance.group_log_ratios(totals, taxa.limit(0), samples, groups).collect() == []


def test_chunks_are_dealt_to_all_tasks(spark):
    rows = spark.range(2000).select(F.lit("s").alias("core"), F.col("id").alias("label"), F.rand(1).alias("v1"))
    chunks = hs.chunked(rows, "core", ["label"], ["v1"], length=20, ws=Workspace(spark, "test"))
    assert chunks.rdd.getNumPartitions() > 1 and chunks.count() == 100


def test_samples_for_forests_fill_absent_features(spark):
    values = spark.createDataFrame([(1, "b", 2.0), (1, "b", 1.0), (2, "a", 5.0), (3, "c", None)], "id long, feature string, value double")
    rows, names = forests.samples(values, spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, label string"))
    assert names == ["a", "b"] and {r.id: (r.label, r.x.toArray().tolist()) for r in rows.collect()} == {1: ("x", [0.0, 3.0]), 2: ("y", [5.0, 0.0])}
