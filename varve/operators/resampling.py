"""Correlations of many resamples in one pass over blocks of vectors, and what modules of nodes keep under them.

Nodes are dealt into blocks by hash; a task holds two blocks of one core, and forms the correlations of all their pairs for
every replicate from the replicate's weights. Weights come from a hash of the replicate, the core and the sample's
place, so none are shipped, and replicate 0 is the data as they are. Only pairs beyond a cutoff, or sums by module, leave
a task.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import ordered
from varve.operators.blocks import BLOCK_VALUES, by_blocks
from varve.operators.components import connected_components

def multiplicities(core: str, n: int, replicate: int) -> np.ndarray:
    """How often each of ``n`` samples, in the order of their labels, is drawn with replacement; replicate 0 draws each once.

    >>> multiplicities("A", 3, 0).tolist()
    [1.0, 1.0, 1.0]
    """
    if replicate == 0:
        return np.ones(n)
    drawn = [int(hashlib.md5(f"{replicate}:{core}:{k}".encode()).hexdigest()[:8], 16) % n for k in range(n)]
    return np.bincount(drawn, minlength=n).astype(float)


def weighted_correlations(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Correlations of the rows of ``x`` with those of ``y`` under sample weights; NaN where a row does not vary."""
    total = w.sum()
    a, b = x - (x @ w / total)[:, None], y - (y @ w / total)[:, None]
    sa, sb = (a * a) @ w, (b * b) @ w
    with np.errstate(divide="ignore", invalid="ignore"):
        r = (a * w) @ b.T / np.sqrt(sa[:, None] * sb[None, :])
    r[sa / total <= 1e-24] = np.nan
    r[:, sb / total <= 1e-24] = np.nan
    return r


def vectors(clr: DataFrame) -> DataFrame:
    """``(core, node, x)``: per core and taxon the log-ratios in the order of the labels."""
    return clr.groupBy("core", F.col("taxon").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("label", "clr"))), lambda s: s["clr"]).alias("x"))


def resampled_edges(clr: DataFrame, replicates: int, cutoff: float = 0.55, min_samples: int = 8, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``(core, replicate, src, dst, r)`` of the pairs with \\|r\\| of at least ``cutoff`` in replicates 0 to ``replicates``, src < dst.

    ``clr`` holds every taxon in every sample of a core once; cores with fewer samples are left out.
    """
    rows = vectors(clr).where(F.size("x") >= min_samples)
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0

    def work(core: str, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame | None:
        x, y = np.array(left["x"].tolist(), dtype=float), np.array(right["x"].tolist(), dtype=float)
        a, b, out = left["node"].to_numpy(), right["node"].to_numpy(), []
        for replicate in range(replicates + 1):
            r = weighted_correlations(x, y, multiplicities(core, x.shape[1], replicate))
            strong = np.abs(r) >= cutoff
            if same:
                strong &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            p, q = np.nonzero(strong)
            swap = a[p] > b[q]
            out.append((np.full(len(p), replicate), np.where(swap, b[q], a[p]), np.where(swap, a[p], b[q]), r[p, q]))
        replicate, src, dst, r = (np.concatenate(v) for v in zip(*out))
        if not len(r):
            return None
        return pd.DataFrame({"core": [core] * len(r), "replicate": replicate, "src": src.tolist(), "dst": dst.tolist(), "r": r})

    return by_blocks(rows, longest, work, "core string, replicate int, src string, dst string, r double", block_values)


def linked_modules(edges: DataFrame) -> DataFrame:
    """``(core, replicate, node, module)``: connected nodes of each replicate's edges, named by the smallest; all replicates at once."""
    key = lambda c: F.struct("core", "replicate", F.col(c).alias("node"))
    found = connected_components(edges.select(key("src").alias("src"), key("dst").alias("dst")))
    return found.select("node.core", "node.replicate", "node.node", F.col("component.node").alias("module"))


def best_matches(modules: DataFrame, replicates: int, min_size: int = 3) -> DataFrame:
    """``(core, module, replicate, matched, jaccard, size, matched_size)`` of every module of replicate 0 in replicates 1 to ``replicates``.

    The match is the module of the replicate with the largest Jaccard similarity, ties to the smallest name; without a
    module that shares a node, similarity is 0 and the match null.
    """
    sizes = modules.groupBy("core", "replicate", "module").agg(F.count(F.lit(1)).alias("size"))
    base = sizes.where((F.col("replicate") == 0) & (F.col("size") >= min_size)).select("core", "module", "size")
    own = modules.where("replicate = 0").select("core", "node", "module")
    met = modules.where("replicate > 0").withColumnRenamed("module", "matched").join(own, ["core", "node"]).groupBy("core", "module", "replicate", "matched").agg(F.count(F.lit(1)).alias("shared"))
    met = met.join(sizes.select("core", "replicate", F.col("module").alias("matched"), F.col("size").alias("matched_size")), ["core", "replicate", "matched"]).join(base, ["core", "module"])
    met = met.withColumn("jaccard", F.col("shared") / (F.col("size") + F.col("matched_size") - F.col("shared")))
    best = met.groupBy("core", "module", "replicate").agg(F.min(F.struct((-F.col("jaccard")).alias("m"), "matched", "matched_size")).alias("b"))
    grid = base.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))) if replicates else base.limit(0).withColumn("replicate", F.lit(0))
    out = grid.join(best, ["core", "module", "replicate"], "left")
    return out.select("core", "module", "replicate", "b.matched", F.coalesce(-F.col("b.m"), F.lit(0.0)).alias("jaccard"), "size", F.coalesce("b.matched_size", F.lit(0)).cast("long").alias("matched_size"))


def permuted_labels(modules: DataFrame, permutations: int) -> DataFrame:
    """``(node, labels)`` of ``(node, module)``: label 0 is the module, label p that of the node whose place the hash of p gives.

    Modules keep their sizes in every permutation.
    """
    spread = modules.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
    spread = spread.withColumn("h", F.when(F.col("p") == 0, F.col("node")).otherwise(F.md5(F.concat_ws(":", F.col("p").cast("string"), "node"))))
    numbered = ordered.positions(ordered.positions(spread, [F.col("node")], ["p"], "given"), [F.col("h"), F.col("node")], ["p"], "place")
    dealt = numbered.select("p", F.col("given").alias("place"), F.col("module").alias("label"))
    rows = numbered.select("p", "node", "place").join(dealt, ["p", "place"])
    return rows.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "label"))), lambda s: s["label"]).alias("labels"))


def preservation(clr: DataFrame, modules: DataFrame, reference: str, permutations: int = 20, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``(core, module, size, density, connectivity, z_density, z_connectivity, z_summary)`` of modules of the core ``reference`` in every other core.

    Density is the mean correlation of a module's pairs, connectivity the correlation, over these pairs, of their
    correlations in both cores. Each is set against random modules of the same sizes: less their mean, over their standard
    deviation. All permutations are carried as an array of labels through one pass. Null where undefined.
    """
    rows = vectors(clr)
    base = rows.where(F.col("core") == reference).select("node", F.col("x").alias("base"))
    rows = rows.where(F.col("core") != reference).join(base, "node").join(permuted_labels(modules, permutations), "node")
    longest = rows.agg(F.max(F.size("x") + F.size("base"))).first()[0] or 0

    def work(core: str, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame | None:
        mat = lambda side, c: np.array(side[c].tolist(), dtype=float)
        x, y, u, v = mat(left, "x"), mat(right, "x"), mat(left, "base"), mat(right, "base")
        here, there = (weighted_correlations(a, b, np.ones(a.shape[1])) for a, b in ((x, y), (u, v)))
        use = np.isfinite(here) & np.isfinite(there)
        if same:
            use &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
        a, b, out = np.array(left["labels"].tolist(), dtype=object), np.array(right["labels"].tolist(), dtype=object), []
        for p in range(permutations + 1):
            names = sorted(set(a[:, p]) & set(b[:, p]))
            for name in names:
                rows_, cols = np.flatnonzero(a[:, p] == name), np.flatnonzero(b[:, p] == name)
                cell = np.ix_(rows_, cols)
                keep = use[cell]
                if not keep.any():
                    continue
                h, t = here[cell][keep], there[cell][keep]
                out.append((core, name, p, float(len(h)), h.sum(), t.sum(), (h * t).sum(), (h * h).sum(), (t * t).sum()))
        return pd.DataFrame(out, columns=["core", "module", "p", "n", "sh", "st", "sht", "shh", "stt"])

    sums = by_blocks(rows, longest + permutations, work, "core string, module string, p int, n double, sh double, st double, sht double, shh double, stt double", block_values)
    sums = sums.groupBy("core", "module", "p").agg(*[F.sum(c).alias(c) for c in ("n", "sh", "st", "sht", "shh", "stt")])
    n = F.col("n")
    spread = F.sqrt((n * F.col("shh") - F.col("sh") * F.col("sh")) * (n * F.col("stt") - F.col("st") * F.col("st")))
    stats = sums.select("core", "module", "p", F.try_divide("sh", "n").alias("density"), F.when((n >= 3) & (spread > 1e-12), (n * F.col("sht") - F.col("sh") * F.col("st")) / spread).alias("connectivity"))
    own = lambda c: F.max(F.when(F.col("p") == 0, F.col(c)))
    chance = lambda c, f: f(F.when(F.col("p") > 0, F.col(c)))
    z = lambda c: F.try_divide(own(c) - chance(c, F.avg), F.when(chance(c, F.stddev_samp) > 1e-12, chance(c, F.stddev_samp)))
    out = stats.groupBy("core", "module").agg(own("density").alias("density"), own("connectivity").alias("connectivity"), z("density").alias("z_density"), z("connectivity").alias("z_connectivity"))
    size = modules.groupBy("module").agg(F.count(F.lit(1)).alias("size"))
    return out.join(size, "module").withColumn("z_summary", (F.col("z_density") + F.col("z_connectivity")) / 2)
