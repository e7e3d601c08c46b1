"""Communities of weighted graphs by modularity: parallel moves, refinement, contraction of the graph in tables.

Many graphs are worked on at once. In every round each community becomes a giver or a receiver, by whether the best move out
of it or into it gains more, and nodes of givers may move to receivers. A node moves if its gain stays positive whatever
the others that leave its community or join its new one do, or if it is the best of both; so every round raises
modularity although moves are decided apart, and the best move of a graph is always made. Everything that a decision needs
are sums and maxima by node or community, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from varve.operators.components import connected_components
from varve.operators.staging import Workspace

#: Gains are compared to this many digits, so that the order of a sum decides nothing.
DIGITS = 12


def _totals(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """``(graph, community, total)``: strength of every community."""
    return placed.join(nodes, ["graph", "node"]).groupBy("graph", "community").agg(F.sum("k").alias("total"))


def _proposals(links: DataFrame, nodes: DataFrame, placed: DataFrame, resolution: float) -> DataFrame:
    """``(graph, node, community, k, two_m, target, gain)`` of the best move of every node that gains by one.

    A gain is that of modularity times the weight of all edges.
    """
    there = placed.select("graph", F.col("node").alias("b"), F.col("community").alias("target"))
    touching = links.join(there, ["graph", "b"]).groupBy("graph", F.col("a").alias("node"), "target").agg(F.sum("w").alias("w"))
    totals = _totals(nodes, placed)
    own = placed.join(nodes, ["graph", "node"]).join(totals.withColumnRenamed("total", "total_own"), ["graph", "community"])
    rows = touching.join(totals.withColumnRenamed("community", "target"), ["graph", "target"]).join(own, ["graph", "node"])
    # The weight towards the own community is a row of its own; without a link to it the node has 0.
    stay = F.when(F.col("target") == F.col("community"), F.col("w"))
    move = F.col("w") - resolution * F.col("k") * (F.col("total") - F.col("total_own") + F.col("k")) / F.col("two_m")
    best = F.min(F.when(F.col("target") != F.col("community"), F.struct((-F.round(move, DIGITS)).alias("loss"), F.col("target").alias("target"))))
    found = rows.groupBy("graph", "node").agg(F.any_value("community").alias("community"), F.any_value("k").alias("k"), F.any_value("two_m").alias("two_m"), F.coalesce(F.max(stay), F.lit(0.0)).alias("stay"), best.alias("best"))
    gain = F.round(-F.col("best.loss") - F.col("stay"), DIGITS)
    return found.select("graph", "node", "community", "k", "two_m", "best.target", gain.alias("gain")).where("gain > 0")


def _accepted(moves: DataFrame, resolution: float) -> DataFrame:
    """``(graph, node, target)`` of the moves that together raise modularity."""
    best = F.max(F.struct("gain", "node"))
    roles = moves.select("graph", F.col("community").alias("c"), F.struct("gain", "node").alias("out"), F.lit(None).cast("struct<gain:double,node:string>").alias("in"))
    roles = roles.unionByName(moves.select("graph", F.col("target").alias("c"), F.lit(None).cast("struct<gain:double,node:string>").alias("out"), F.struct("gain", "node").alias("in")))
    roles = roles.groupBy("graph", "c").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    gives = F.col("in").isNull() | (F.col("out") > F.col("in"))
    takes = F.col("out").isNull() | (F.col("in") >= F.col("out"))
    givers, takers = roles.where(gives).select("graph", F.col("c").alias("community")), roles.where(takes).select("graph", F.col("c").alias("target"))
    wanted = moves.join(givers, ["graph", "community"], "left_semi").join(takers, ["graph", "target"], "left_semi")
    into = wanted.groupBy("graph", "target").agg(F.sum("k").alias("k_in"), best.alias("best_in"))
    out = wanted.groupBy("graph", "community").agg(F.sum("k").alias("k_out"), best.alias("best_out"))
    rows = wanted.join(into, ["graph", "target"]).join(out, ["graph", "community"])
    crowd = resolution * F.col("k") * (F.col("k_in") + F.col("k_out") - 2 * F.col("k")) / F.col("two_m")
    both = (F.col("node") == F.col("best_in.node")) & (F.col("node") == F.col("best_out.node"))
    return rows.where(both | (F.round(F.col("gain") - crowd, DIGITS) > 0)).select("graph", "node", "target")


def _settled(links: DataFrame, nodes: DataFrame, placed: DataFrame, resolution: float, ws: Workspace, max_rounds: int) -> DataFrame:
    """``placed`` after moves until no node gains by one; ``max_rounds`` bounds only the time, every state is a valid one."""
    for _ in range(max_rounds):
        watch = Observation()
        moves = ws.table(_proposals(links, nodes, placed, resolution).observe(watch, F.count(F.lit(1)).alias("n")), "moves")
        if not watch.get["n"]:
            break
        accepted = _accepted(moves, resolution)
        placed = ws.table(placed.join(accepted, ["graph", "node"], "left").select("graph", "node", F.coalesce("target", "community").alias("community")), "placed")
    return placed


def _connected(links: DataFrame, placed: DataFrame) -> DataFrame:
    """``placed`` with every community split into its connected parts, each named by its smallest node."""
    end = lambda c: placed.select("graph", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    inner = links.where("a < b").join(end("a"), ["graph", "a"]).join(end("b"), ["graph", "b"]).where("ca = cb")
    key = lambda c: F.struct(F.col("graph"), F.col(c).alias("node"))
    found = connected_components(inner.select(key("a").alias("src"), key("b").alias("dst"))).select("node.graph", "node.node", F.col("component.node").alias("part"))
    return placed.join(found, ["graph", "node"], "left").select("graph", "node", F.coalesce("part", "node").alias("community"))


def communities(edges: DataFrame, resolution: float = 1.0, max_rounds: int = 200, max_levels: int = 20) -> DataFrame:
    """``(graph, node, community)`` of every node of ``(graph, src, dst, weight)``; a community is named by its smallest node.

    Edges are undirected, parallel ones add up, those without a positive weight and loops are left out. Every community is
    connected. Equal gains go to the smallest community, so the result does not depend on how the rows are dealt.
    """
    ws = Workspace(edges.sparkSession, "communities")
    once = edges.where("weight > 0 and src <> dst and src is not null and dst is not null").groupBy("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("weight").alias("w"))
    once = ws.table(once, "edges")
    base = ws.table(once.unionByName(once.select("graph", F.col("b").alias("a"), F.col("a").alias("b"), "w")), "links")
    strength = base.groupBy("graph", F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    weight = strength.groupBy("graph").agg(F.sum("k").alias("two_m"))
    first = ws.table(strength.join(weight, "graph"), "nodes")
    links, nodes = base, first
    placed = first.select("graph", "node", F.col("node").alias("community"))
    members = None  # (graph, node, top): node of the first graph to node of the present one
    for _ in range(max_levels):
        placed = _settled(links, nodes, placed, resolution, ws, max_rounds)
        # Refinement: from single nodes again, along links inside a community only.
        end = lambda c: placed.select("graph", F.col("node").alias(c), F.col("community").alias(f"c{c}"))  # noqa: E731, B023
        inner = ws.table(links.join(end("a"), ["graph", "a"]).join(end("b"), ["graph", "b"]).where("ca = cb").select("graph", "a", "b", "w"), "inner")
        refined = _settled(inner, nodes, nodes.select("graph", "node", F.col("node").alias("community")), resolution, ws, max_rounds)
        refined = ws.table(_connected(inner, refined), "refined")
        step = refined.select("graph", F.col("node").alias("top"), F.col("community").alias("next"))
        members = refined.select("graph", "node", F.col("community").alias("top")) if members is None else members.join(step, ["graph", "top"]).select("graph", "node", F.col("next").alias("top"))
        members = ws.table(members, "members")
        contracted = ws.table(nodes.join(refined, ["graph", "node"]).groupBy("graph", F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.any_value("two_m").alias("two_m")), "nodes")
        shrunk = contracted.count() < nodes.count()
        # A refined community starts in the community that holds it.
        outer = refined.join(placed.withColumnRenamed("community", "outer"), ["graph", "node"]).groupBy("graph", F.col("community").alias("node")).agg(F.min("outer").alias("community"))
        placed = ws.table(outer, "placed")
        if not shrunk:
            break
        to = lambda c: refined.select("graph", F.col("node").alias(c), F.col("community").alias(f"n{c}"))  # noqa: E731, B023
        links = links.join(to("a"), ["graph", "a"]).join(to("b"), ["graph", "b"]).where("na <> nb").groupBy("graph", F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w"))
        links, nodes = ws.table(links, "links"), contracted
    if members is None:
        return placed
    last = placed.select("graph", F.col("node").alias("top"), "community")
    whole = ws.table(members.join(last, ["graph", "top"]).select("graph", "node", "community"), "whole")
    whole = _settled(base, first, whole, resolution, ws, max_rounds)
    return ws.table(_connected(base, whole), "communities")


def modularity(edges: DataFrame, placed: DataFrame, resolution: float = 1.0) -> DataFrame:
    """``(graph, modularity)`` of ``(graph, src, dst, weight)`` under ``(graph, node, community)``."""
    end = lambda c: placed.select("graph", F.col("node").alias(c), F.col("community").alias(f"c{c}"))
    rows = edges.where("weight > 0 and src <> dst").join(end("src"), ["graph", "src"]).join(end("dst"), ["graph", "dst"])
    both = rows.select("graph", F.col("csrc").alias("community"), "weight").unionByName(rows.select("graph", F.col("cdst").alias("community"), "weight"))
    degree = both.groupBy("graph", "community").agg(F.sum("weight").alias("k")).groupBy("graph").agg(F.sum("k").alias("two_m"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    inner = rows.groupBy("graph").agg(F.sum(F.when(F.col("csrc") == F.col("cdst"), F.col("weight")).otherwise(0.0)).alias("inner"))
    return degree.join(inner, "graph").select("graph", (2 * F.col("inner") / F.col("two_m") - resolution * F.col("squares") / (F.col("two_m") * F.col("two_m"))).alias("modularity"))
