"""Association graphs and their comparison. Edges are ``(core, src, dst, signed_weight, weight)`` with src < dst."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.columns import average_rank
from varve.operators import blocks
from varve.operators.components import connected_components
from varve.operators.staging import Workspace


def unit_vectors(clr: DataFrame, method: str) -> DataFrame:
    """Per taxon and core a vector over samples whose dot products are the correlations of ``method``."""
    w = Window.partitionBy("core", "taxon")
    x = clr.select("core", "label", "taxon", F.col("clr").alias("x"))
    if method == "spearman":
        x = x.withColumn("x", average_rank("x", ["core", "taxon"]))
    centred = F.col("x") - F.avg("x").over(w)
    if method == "bicor":
        x = x.withColumn("med", F.median("x").over(w)).withColumn("dev", F.col("x") - F.col("med"))
        x = x.withColumn("mad", F.median(F.abs("dev")).over(w)).withColumn("u", F.try_divide("dev", 9 * F.col("mad")))
        weighted = F.when(F.abs("u") < 1, F.col("dev") * F.pow(1 - F.col("u") * F.col("u"), 2)).otherwise(0.0)
        centred = F.when(F.col("mad") == 0, centred).otherwise(weighted)
    x = x.withColumn("c", centred)
    norm = F.sqrt(F.sum(F.col("c") * F.col("c")).over(w))
    return x.select("core", "label", "taxon", F.try_divide("c", F.when(norm > 1e-12, norm)).alias("x"))


def correlations(clr: DataFrame, method: str = "pearson", min_samples: int = 8, cutoff: float | None = None) -> DataFrame:
    """``(core, src, dst, n, r)`` of the taxon pairs of a core with enough common samples, and with a ``cutoff`` only those of at least that size.

    Vectors are stored once; pairs are formed block by block in tasks, so no row per pair and sample exists.
    """
    v = unit_vectors(clr, method).where("x is not null")
    rows = v.groupBy("core", F.col("taxon").alias("node")).agg(F.array_sort(F.collect_list(F.struct("label", "x"))).alias("v"))
    rows = rows.select("core", "node", F.transform("v", lambda s: s["label"]).alias("labels"), F.transform("v", lambda s: s["x"]).alias("x"))
    return blocks.products(Workspace(clr.sparkSession, "vectors").table(rows, "vectors"), min_samples, cutoff)


def mutual_information(rho: str = "r"):
    return -0.5 * F.log(1 - F.least(F.col(rho) * F.col(rho), F.lit(0.999999)))


def association_graph(clr: DataFrame, method: str = "pearson", cutoff: float = 0.55, min_samples: int = 8) -> DataFrame:
    if method == "mi_aracne":
        # Ten digits, so that equal associations do not differ by the order of a sum.
        mi = correlations(clr, "spearman", min_samples).select("core", "src", "dst", F.round(mutual_information(), 10).alias("weight")).where("weight > 0")
        return aracne(mi).withColumn("signed_weight", F.col("weight"))
    r = correlations(clr, method, min_samples, cutoff)
    return r.select("core", "src", "dst", F.col("r").alias("signed_weight"), F.abs("r").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    back = edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})
    return edges.unionByName(back)


def aracne(edges: DataFrame, eps: float = 0.0) -> DataFrame:
    """Without the edges that are weaker than both other edges of some triangle."""
    e = both_ways(edges.select("core", "src", "dst", "weight"))
    one = e.select("core", "src", F.col("dst").alias("mid"), F.col("weight").alias("w1"))
    two = e.select("core", F.col("src").alias("mid"), "dst", F.col("weight").alias("w2"))
    weak = (
        edges.select("core", "src", "dst", "weight")
        .join(one, ["core", "src"])
        .join(two, ["core", "mid", "dst"])
        .where(F.col("weight") < F.least("w1", "w2") - eps)
        .select("core", "src", "dst")
        .distinct()
    )
    return edges.join(weak, ["core", "src", "dst"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("core", F.col("src").alias("taxon")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def graph_components(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(core, taxon, component)`` of every vertex; component is the smallest taxon it reaches."""
    key = lambda c: F.struct(F.col("core"), F.col(c).alias("taxon"))
    found = connected_components(edges.select(key("src").alias("src"), key("dst").alias("dst")))
    found = found.select("node.core", "node.taxon", F.col("component.taxon").alias("component"))
    return vertices.select("core", "taxon").join(found, ["core", "taxon"], "left").withColumn("component", F.coalesce("component", "taxon"))


def summary(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Nodes, edges, density and number of components per core."""
    parts = graph_components(edges, vertices).groupBy("core").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("components"))
    counts = edges.groupBy("core").agg(F.count(F.lit(1)).alias("edges"))
    out = parts.join(counts, "core", "left").fillna(0, ["edges"])
    return out.withColumn("density", F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))


def edge_jaccard(edges: DataFrame) -> DataFrame:
    """Intersection, union and Jaccard similarity of the edge sets of every pair of cores; null where both are empty."""
    sizes = edges.groupBy("core").agg(F.count(F.lit(1)).alias("m"))
    a, b = edges.select(F.col("core").alias("core_a"), "src", "dst"), edges.select(F.col("core").alias("core_b"), "src", "dst")
    shared = a.join(b, ["src", "dst"]).where("core_a < core_b").groupBy("core_a", "core_b").agg(F.count(F.lit(1)).alias("shared"))
    sa, sb = sizes.select(F.col("core").alias("core_a"), F.col("m").alias("ma")), sizes.select(F.col("core").alias("core_b"), F.col("m").alias("mb"))
    out = sa.join(sb, F.col("core_a") < F.col("core_b")).join(shared, ["core_a", "core_b"], "left").fillna(0, ["shared"])
    union = F.col("ma") + F.col("mb") - F.col("shared")
    return out.select("core_a", "core_b", F.col("shared").alias("edge_intersection"), union.alias("edge_union"), F.try_divide("shared", union).alias("edge_jaccard"))


def spectral_signatures(edges: DataFrame, vertices: DataFrame, k: int = 30) -> DataFrame:
    """``(core, signature)``: k quantiles of the normalised Laplacian's eigenvalues. One graph (at most some hundred taxa) is one group."""

    def signature(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        place = {t: i for i, t in enumerate(sorted(nodes["taxon"]))}
        a = np.zeros((len(place), len(place)))
        i, j = links["src"].map(place).to_numpy(), links["dst"].map(place).to_numpy()
        a[i, j] = a[j, i] = links["weight"]
        degree = a.sum(1)
        scale = np.where(degree > 0, 1 / np.sqrt(np.where(degree > 0, degree, 1)), 0)
        laplacian = np.diag((degree > 0).astype(float)) - a * scale[:, None] * scale[None, :]
        values = np.quantile(np.linalg.eigvalsh(laplacian), np.linspace(0, 1, k)) if len(place) else np.zeros(k)
        return pd.DataFrame({"core": [key[0]], "signature": [np.maximum(values, 0).tolist()]})

    # Both sides may stem from one table, so the key of one side gets a name of its own.
    groups = vertices.select(F.col("core").alias("vertex_core"), "taxon").groupBy("vertex_core").cogroup(edges.select("core", "src", "dst", "weight").groupBy("core"))
    return groups.applyInPandas(signature, "core string, signature array<double>")


def path_measures(edges: DataFrame) -> DataFrame:
    """``(core, taxon, closeness, betweenness, efficiency)`` with edge length 1 - weight (at least 1e-6); one graph is one group."""

    def measure(key: tuple, links: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(links["src"]) | set(links["dst"]))
        place = {t: i for i, t in enumerate(names)}
        n = len(names)
        near: list[list[tuple[int, float]]] = [[] for _ in names]
        for s, d, w in zip(links["src"], links["dst"], links["weight"]):
            length = max(1 - w, 1e-6)
            near[place[s]].append((place[d], length))
            near[place[d]].append((place[s], length))
        between, close, eff = np.zeros(n), np.zeros(n), np.zeros(n)
        for s in range(n):
            order, dist, paths, before = _shortest(near, s)
            reached = [v for v in order if v != s]
            total = sum(dist[v] for v in reached)
            close[s] = len(reached) / total if total else 0.0
            eff[s] = sum(1 / dist[v] for v in reached) / max(n - 1, 1)
            share = np.zeros(n)
            for v in reversed(order):
                for u in before[v]:
                    share[u] += paths[u] / paths[v] * (1 + share[v])
                if v != s:
                    between[v] += share[v]
        scale = (n - 1) * (n - 2)
        return pd.DataFrame({"core": key[0], "taxon": names, "closeness": close, "betweenness": between / scale if scale > 0 else between, "efficiency": eff})

    schema = "core string, taxon string, closeness double, betweenness double, efficiency double"
    return edges.select("core", "src", "dst", "weight").groupBy("core").applyInPandas(measure, schema)


def _shortest(near: list[list[tuple[int, float]]], source: int):
    """Order of settling, distances, path counts and predecessors from one source."""
    import heapq

    dist, paths, before, order = {source: 0.0}, {source: 1.0}, {source: []}, []
    done, heap = set(), [(0.0, source)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in done:
            continue
        done.add(v)
        order.append(v)
        for u, length in near[v]:
            through = d + length
            if u not in dist or through < dist[u] - 1e-12:
                dist[u], paths[u], before[u] = through, paths[v], [v]
                heapq.heappush(heap, (through, u))
            elif abs(through - dist[u]) <= 1e-12 and u not in done:
                paths[u] += paths[v]
                before[u].append(v)
    return order, dist, paths, before


def page_rank(edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """Weighted PageRank per core; the graph has no dangling vertex because every edge counts both ways."""
    ws = Workspace(edges.sparkSession, "rank")
    links = both_ways(edges.select("core", "src", "dst", "weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy("core", "src"))
    links = ws.table(links.select("core", "src", "dst", share.alias("share")), "links")
    nodes = links.select("core", F.col("src").alias("taxon")).distinct()
    nodes = nodes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("core")))
    rank = nodes.withColumn("rank", 1.0 / F.col("n"))
    for i in range(rounds):
        sent = links.join(rank.select("core", F.col("taxon").alias("src"), "rank"), ["core", "src"])
        got = sent.groupBy("core", F.col("dst").alias("taxon")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        rank = nodes.join(got, ["core", "taxon"], "left").select(
            "core", "taxon", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("in", F.lit(0.0))).alias("rank")
        )
        if i % 5 == 4:
            rank = ws.table(rank, "round")
    return rank.select("core", "taxon", "rank")


def module_roles(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Within-module z and participation of every node, with its role; ``modules`` is ``(taxon, module)``."""
    links = both_ways(edges.select("core", "src", "dst", "weight"))
    own = modules.select(F.col("taxon").alias("src"), F.col("module").alias("own"))
    other = modules.select(F.col("taxon").alias("dst"), F.col("module").alias("other"))
    by = links.join(own, "src").join(other, "dst").groupBy("core", F.col("src").alias("taxon"), "own", "other").agg(F.sum("weight").alias("k"))
    node = by.groupBy("core", "taxon", F.col("own").alias("module")).agg(
        F.sum("k").alias("strength"), F.sum(F.when(F.col("own") == F.col("other"), F.col("k")).otherwise(0.0)).alias("within"), F.sum(F.col("k") * F.col("k")).alias("squares")
    )
    w = Window.partitionBy("core", "module")
    z = F.coalesce(F.try_divide(F.col("within") - F.avg("within").over(w), F.stddev_samp("within").over(w)), F.lit(0.0))
    p = 1 - F.try_divide("squares", F.col("strength") * F.col("strength"))
    out = node.select("core", "taxon", "module", "strength", z.alias("z"), p.alias("participation"))
    role = (
        F.when((F.col("z") > 2.5) & (F.col("participation") > 0.62), "network_hub")
        .when(F.col("z") > 2.5, "module_hub")
        .when(F.col("participation") > 0.62, "connector")
        .otherwise("peripheral")
    )
    return out.withColumn("role", role)
