"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two minimum aggregations (combined map-side) and two equi-joins, so a hub with
a third of all edges costs no collected group: its minimum is pre-aggregated and its edges are
split by AQE's skew join. The edge table of each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from varve.operators.staging import Workspace


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of ``edges``; component is its smallest node.

    Edges with a null end are ignored; self-loops and repeated edges are harmless; an empty
    edge table gives an empty result. Works on any orderable key type.
    """
    ws = Workspace(edges.sparkSession, "components")
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = None
    current = ws.table(
        given.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    loops = current.where("u = v").select("u")
    star = current.where("u <> v")
    previous, last = None, current
    for _ in range(max_rounds):
        watch = Observation()
        nxt = _round(star).observe(watch, F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"))
        table = ws.table(nxt, "round")
        seen = (watch.get["n"], watch.get["x"])
        if last is not current:
            ws.drop(last)
        star = last = table
        if seen == previous or seen[0] == 0:
            break
        previous = seen
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds")
    roots = star.select(F.col("v").alias("node")).union(loops.select(F.col("u").alias("node"))).distinct()
    nodes = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = roots.join(nodes.select("node"), "node", "left_anti")
    return nodes.unionByName(roots.select("node", F.col("node").alias("component")))


def _round(star: DataFrame) -> DataFrame:
    both = star.select("u", "v").union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("low"))
    small = large.join(least, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.union(least.select("u", F.col("low").alias("v"))).where("u <> v").distinct()
