"""Soft modules of nodes in several graphs at once, coupled across the graphs.

Every node of a graph has a vector s >= 0 with one value per module. The vectors lower

    sum over graphs |A - S S'|^2  +  sum over pairs of graphs, over the nodes they share, c |s - t|^2

where A has 1 on its diagonal and c is the pair's coupling. A coupling between two graphs acts like one more set of edges,
so a round is one join of edges with vectors, one sum by target, and a k x k product per graph. Each round multiplies s by

    ((2 A S + C) / (2 S S'S + c s)) ^ (1/4)

(C is the coupled vectors' weighted sum, c the sum of its weights), the minimum of a bound that touches the objective at the
present vectors; so it never rises, whatever the edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.staging import Workspace


def dimensions(n_nodes: int) -> tuple[int, int]:
    """Numbers of modules on the first and second level for so many nodes."""
    first = max(4, min(32, round(n_nodes**0.5)))
    return first, max(2, first // 2)


def _hashed(*parts) -> F.Column:
    """A number in [0, 1) by the text of ``parts``."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(16**13)


def targets(nodes: DataFrame, edges: DataFrame, couplings: list[tuple[str, str, float]]) -> DataFrame:
    """``(graph, node, from_graph, from_node, weight)``: edges both ways, the diagonal, and couplings between nodes of the same name.

    ``nodes`` is ``(graph, node)``, ``edges`` is ``(graph, a, b, weight)`` once per edge; edges with an end that is no node,
    loops and weights that are not above 0 have no part. Couplings of two graphs are named once.
    """
    nodes = nodes.select("graph", "node").distinct()
    known = edges.where("a <> b and weight > 0").join(nodes.withColumnRenamed("node", "a"), ["graph", "a"], "left_semi").join(nodes.withColumnRenamed("node", "b"), ["graph", "b"], "left_semi")
    rows = known.select("graph", F.col("a").alias("node"), F.col("graph").alias("from_graph"), F.col("b").alias("from_node"), (2 * F.col("weight")).alias("weight"))
    rows = rows.unionByName(rows.withColumns({"node": F.col("from_node"), "from_node": F.col("node")}))
    rows = rows.unionByName(nodes.select("graph", "node", F.col("graph").alias("from_graph"), F.col("node").alias("from_node"), F.lit(2.0).alias("weight")))
    both = [(p, q, float(c)) for p, q, c in couplings if c > 0 and p != q]
    both += [(q, p, c) for p, q, c in both]
    if both:
        # One row per pair of graphs, given as arguments.
        listed = nodes.sparkSession.createDataFrame(both, "graph string, from_graph string, weight double")
        ends = nodes.join(F.broadcast(listed), "graph")
        there = nodes.select(F.col("graph").alias("from_graph"), F.col("node"))
        rows = rows.unionByName(ends.join(there, ["from_graph", "node"]).select("graph", "node", "from_graph", F.col("node").alias("from_node"), "weight"))
    return rows


def gram(rows: DataFrame, left: str, right: str, k: int) -> dict[str, np.ndarray]:
    """Per graph the k x k sum of the outer products of two vectors of every row; k and the number of graphs bound what comes back."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for graph, part in batch.groupby("graph", sort=False):
                product = np.stack(part["l"].to_numpy()).T @ np.stack(part["r"].to_numpy())
                sums[graph] = sums.get(graph, 0) + product
        for graph, product in sums.items():
            yield pd.DataFrame({"graph": graph, "at": np.arange(product.size), "v": product.ravel()})

    summed = rows.select("graph", F.col(left).alias("l"), F.col(right).alias("r")).mapInPandas(partial, "graph string, at int, v double").groupBy("graph", "at").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for graph, at, v in summed.collect():
        out.setdefault(graph, np.zeros(k * k))[at] = v
    return {g: m.reshape(k, k) for g, m in out.items()}


def fit(nodes: DataFrame, edges: DataFrame, k: int, couplings: list[tuple[str, str, float]], rounds: int = 20, ws: Workspace | None = None) -> tuple[DataFrame, list[float]]:
    """``(graph, node, s array<double>)`` after so many rounds, and the objective before each round and at the end.

    Nodes start from hashes of their name, the same in all graphs. Names that are null have no part; repeated nodes count once,
    repeated edges add up; without nodes there are no rows and every objective is 0.
    """
    ws = ws or Workspace(nodes.sparkSession, "soft-modules")
    nodes = ws.table(nodes.where("graph is not null and node is not null").select("graph", "node").distinct(), "nodes")
    summed = edges.groupBy("graph", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("weight").alias("weight"))
    reach = ws.table(targets(nodes, summed, couplings), "targets")
    # The part of the objective that no vector changes, and how much coupling a node has.
    square = reach.where("graph = from_graph").agg(F.sum(F.col("weight") * F.col("weight") / 4)).first()[0] or 0.0
    pull = ws.table(reach.groupBy("graph", "node").agg(F.coalesce(F.sum(F.when(F.col("graph") != F.col("from_graph"), F.col("weight"))), F.lit(0.0)).alias("c")), "pull")
    start = [(0.5 + _hashed(F.lit("soft"), F.col("node"), F.lit(i))) / k**0.5 for i in range(k)]
    state = ws.table(nodes.select("graph", "node", F.array(*start).alias("s")), "start")
    reached: list[float] = []
    for turn in range(rounds + 1):
        products = gram(state, "s", "s", k)
        sent = state.select(F.col("graph").alias("from_graph"), F.col("node").alias("from_node"), "s")
        got = reach.join(sent, ["from_graph", "from_node"]).groupBy("graph", "node").agg(F.array(*[F.sum(F.col("weight") * F.col("s")[i]) for i in range(k)]).alias("p"))
        rows = state.join(got, ["graph", "node"]).join(pull, ["graph", "node"])

        def move(batches: Iterator[pd.DataFrame], products=products) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for graph, part in batch.groupby("graph", sort=False):
                    s, p, c = np.stack(part["s"].to_numpy()), np.stack(part["p"].to_numpy()), part["c"].to_numpy()[:, None]
                    cost = c[:, 0] * (s * s).sum(1) - (s * p).sum(1)
                    s = s * (p / np.maximum(2 * s @ products[graph] + c * s, 1e-300)) ** 0.25
                    yield pd.DataFrame({"graph": graph, "node": part["node"].to_numpy(), "s": list(s), "cost": cost})

        moved = ws.table(rows.mapInPandas(move, "graph string, node string, s array<double>, cost double"), "moved")
        reached.append(float(square + sum((m * m).sum() for m in products.values()) + (moved.agg(F.sum("cost")).first()[0] or 0.0)))
        if turn < rounds:
            ws.drop(state)
            state = moved
    return state.select("graph", "node", "s"), reached


def memberships(state: DataFrame) -> DataFrame:
    """``(graph, node, probability)``: vectors scaled to sum 1; a vector of zeros becomes equal shares."""
    total = F.aggregate("s", F.lit(0.0), lambda u, v: u + v)
    share = F.transform("s", lambda v: F.when(F.col("total") > 0, v / F.col("total")).otherwise(1.0 / F.size("s")))
    return state.withColumn("total", total).select("graph", "node", share.alias("probability"))


def consensus(assigned: DataFrame, k: int) -> DataFrame:
    """``(node, module, mean_entropy, n_graphs)``: the module of the largest mean probability over a node's graphs, the first of equals."""
    entropy = F.aggregate("probability", F.lit(0.0), lambda u, p: u - p * F.log(p + 1e-12))
    means = assigned.withColumn("entropy", entropy).groupBy("node").agg(F.array(*[F.round(F.avg(F.col("probability")[i]), 12) for i in range(k)]).alias("mean"), F.avg("entropy").alias("mean_entropy"), F.count(F.lit(1)).alias("n_graphs"))
    return means.select("node", F.array_position("mean", F.array_max("mean")).cast("int").alias("module"), "mean_entropy", "n_graphs")


def pooled(assigned: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """``(graph, a, b, weight)`` of the modules as nodes ``M1``..``Mk``: edges shared out by both ends' probabilities, scaled by the graph's largest weight."""
    both = edges.select("graph", "a", "b", "weight").unionByName(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    ends = lambda c, p: assigned.select("graph", F.col("node").alias(c), F.col("probability").alias(p))
    got = both.join(ends("b", "q"), ["graph", "b"]).groupBy("graph", "a").agg(F.array(*[F.sum(F.col("weight") * F.col("q")[i]) for i in range(k)]).alias("q"))
    products = gram(got.join(ends("a", "p"), ["graph", "a"]), "p", "q", k)
    rows = [(g, f"M{i + 1}", f"M{j + 1}", float(m[i, j] / m.max())) for g, m in products.items() if m.max() > 0 for i in range(k) for j in range(i + 1, k)]
    return edges.sparkSession.createDataFrame(rows, "graph string, a string, b string, weight double")
