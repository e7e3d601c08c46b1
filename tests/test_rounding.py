"""Doubles are rounded as the SQL twins round them, also at halves that are not exact."""

from __future__ import annotations

import math

import duckdb
from pyspark.sql import functions as F

from varve.functions import columns as C


def test_quotients_of_counts_round_as_in_sql(spark):
    sql = "SELECT k, n, {} AS x FROM (SELECT unnest(range(-700, 1400)) AS k), (VALUES (640), (3200), (43520)) t(n)"
    want = {(k, n): x for k, n, x in duckdb.sql(sql.format("round(k::DOUBLE/n,6)")).fetchall()}
    rows = spark.createDataFrame([(k, n) for k, n in want], "k int, n int")
    got = rows.select("k", "n", C.rounded(F.col("k") / F.col("n"), 6).alias("x"), F.round(F.col("k") / F.col("n"), 6).alias("other")).collect()
    assert all(r.x == want[r.k, r.n] for r in got)
    assert any(r.other != want[r.k, r.n] for r in got)  # what Spark's own rounding makes of 41 / 640


def test_what_rounds_to_zero_keeps_its_sign_as_in_sql(spark):
    values = [-4e-7, -5e-7, -1e-300, -0.0, 0.0, 4e-7, -6e-7, -1.5e-6, 2.5e-6, float("inf"), float("-inf")]
    sql = duckdb.sql(f"SELECT round(x,6) FROM (SELECT unnest({[str(v) for v in values]}::DOUBLE[]) AS x)").fetchall()
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", C.rounded(F.col("x"), 6).alias("x")).orderBy("i").collect()
    assert [(r.x, math.copysign(1, r.x)) for r in got] == [(x, math.copysign(1, x)) for (x,) in sql]


def test_features_of_a_taxon_keep_the_sign_of_zero(spark, sf):
    from varve.plans import knowledge
    from varve.sources.domain import Domain

    d = Domain(spark, sf)
    d.clr_primary = spark.createDataFrame([("t", -3e-7, 1.0), ("t", -1e-7, 0.0)], "taxon string, clr double, abundance double")
    mean = next(r.features[0] for r in knowledge.padded_features(d).collect() if r.node == "taxon:t")
    assert mean == 0 and math.copysign(1, mean) == -1
