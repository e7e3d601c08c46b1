"""Link prediction: node vectors from profiles and neighbours, absent pairs, a calibrated model of pair features.

Nodes are ``(node, z array<double>, sites array<double>)``, ``sites`` holding 1 for every site where the node occurs.
Pairs are unordered, kept as ``(a, b)`` with a < b.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.operators import ordered
from varve.operators.staging import Workspace

FEATURES = ["cosine", "shared_sites", "min_sites", "max_sites"]


def diffused(x: DataFrame, links: DataFrame, dims: int) -> DataFrame:
    """``(node, z)``: each vector plus its neighbours' vectors, weighted by w / sqrt(s_i s_j) with strengths s.

    ``x`` is ``(node, x array<double>)`` of ``dims`` values, ``links`` is ``(a, b, weight)`` once per edge; several edges
    between two nodes (one per site) add up. A node without edges keeps its vector; neighbours without a vector count as 0.
    """
    both = links.select("a", "b", "weight").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    strength = both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("s"))
    scaled = x.join(strength, "node").select(F.col("node").alias("b"), *[(F.col("x")[k] / F.sqrt("s")).alias(f"x{k}") for k in range(dims)])
    gathered = both.join(scaled, "b").groupBy(F.col("a").alias("node")).agg(*[F.sum(F.col("weight") * F.col(f"x{k}")).alias(f"g{k}") for k in range(dims)])
    gathered = gathered.join(strength, "node").select("node", F.array(*[F.col(f"g{k}") / F.sqrt("s") for k in range(dims)]).alias("g"))
    z = F.zip_with("x", F.coalesce("g", F.array(*[F.lit(0.0)] * dims)), lambda p, q: p + q)
    return x.join(gathered, "node", "left").select("node", z.alias("z"))


def pair_features(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` with FEATURES, for listed pairs: two equi-joins; pairs with an unknown end go."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("z").alias(f"z{c}"), F.col("sites").alias(f"s{c}"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda u, v: u + v)
    rows = pairs.join(end("a"), "a").join(end("b"), "b")
    return rows.select(*pairs.columns, C.cosine("za", "zb").alias("cosine"), C.dot("sa", "sb").alias("shared_sites"), F.least(total("sa"), total("sb")).alias("min_sites"), F.greatest(total("sa"), total("sb")).alias("max_sites"))


@dataclass(frozen=True)
class LinkModel:
    """Logistic model of standardised features."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float

    def logit(self, features: np.ndarray) -> np.ndarray:
        return (features - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.intercept

    def score(self, columns: list[str]) -> Column:
        total = F.lit(self.intercept)
        for c, m, s, w in zip(columns, self.mean, self.scale, self.weights, strict=True):
            total = total + (F.col(c) - m) / s * w
        return 1 / (1 + F.exp(-total))


def fit(rows: DataFrame, features: list[str], label: str = "label", strength: float = 1.0) -> LinkModel:
    """Balanced logistic regression on standardised features: the minimum of |w|^2 / 2 + strength * sum of weighted losses.

    A class of n_c of n rows weighs n / (2 n_c) a row; the intercept is free; constant features get the scale 1. Raises if
    only one class is there. ``rows`` is read once per iteration, so it should be a stored table.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("positive"), *[f(c).alias(f"{c}_{k}") for c in features for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not seen.positive or seen.positive == seen.n:
        raise ValueError("both classes are needed")
    mean, scale = [seen[f"{c}_m"] for c in features], [seen[f"{c}_s"] or 1.0 for c in features]
    weight = F.when(F.col(label) == 1, seen.n / (2 * seen.positive)).otherwise(seen.n / (2 * (seen.n - seen.positive)))
    x = array_to_vector(F.array(*[(F.col(c) - m) / s for c, m, s in zip(features, mean, scale, strict=True)]))
    table = rows.select(F.col(label).cast("double").alias("label"), weight.alias("weight"), x.alias("features"))
    solver = LogisticRegression(weightCol="weight", regParam=1 / (strength * seen.n), standardization=False, maxIter=300, tol=1e-13)
    model = solver.fit(table)
    return LinkModel(mean, scale, list(map(float, model.coefficients)), float(model.intercept))


def hashed(*parts: Column) -> Column:
    """A number below 2^60 from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def absent_by_blocks(nodes: DataFrame, observed: DataFrame, model: LinkModel | None = None, block_rows: int = 512) -> DataFrame:
    """``(a, b, FEATURES..., score)`` of every pair of nodes that is not observed; score is null without a model.

    Nodes are dealt into blocks by hash, and every pair of blocks is one matrix product in one task, from which observed
    pairs are taken out by a mask. Rows of a pair of blocks: two blocks of nodes and the observed pairs between them.
    """
    n_blocks = max(-(-nodes.count() // block_rows), 1)
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
    spread = nodes.select("node", "z", "sites", block("node").alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    spread = spread.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), "z", "sites", "own")
    known = observed.select("a", "b").select(F.least(block("a"), block("b")).alias("i"), F.greatest(block("a"), block("b")).alias("j"), "a", "b").distinct()
    known = known.withColumns({"z": F.lit(None).cast("array<double>"), "sites": F.lit(None).cast("array<double>"), "own": F.lit(-1)})
    columns = ["a", "b", *FEATURES, "score"]

    def pairs(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        ends = rows[rows["own"] >= 0].sort_values("a")
        left, right = ends[ends["own"] == i], ends[ends["own"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame(columns=columns, dtype=object)
        z1, z2 = np.array(left["z"].tolist()), np.array(right["z"].tolist())
        s1, s2 = np.array(left["sites"].tolist()), np.array(right["sites"].tolist())
        n1, n2 = left["a"].to_numpy(), right["a"].to_numpy()
        free = n1[:, None] < n2[None, :] if i == j else np.ones((len(n1), len(n2)), dtype=bool)
        at1, at2 = {n: k for k, n in enumerate(n1)}, {n: k for k, n in enumerate(n2)}
        for a, b in rows.loc[rows["own"] < 0, ["a", "b"]].itertuples(index=False):
            for p, q in ((a, b), (b, a)):
                if p in at1 and q in at2:
                    free[at1[p], at2[q]] = False
        p, q = np.nonzero(free)
        cosine = (z1 @ z2.T / np.maximum(np.sqrt((z1 * z1).sum(1))[:, None] * np.sqrt((z2 * z2).sum(1))[None, :], 1e-12))[p, q]
        own, other = s1.sum(1)[p], s2.sum(1)[q]
        features = np.stack([cosine, (s1 @ s2.T)[p, q], np.minimum(own, other), np.maximum(own, other)], axis=1)
        a, b = n1[p], n2[q]
        swap = a > b
        out = pd.DataFrame(features, columns=FEATURES)
        out.insert(0, "a", np.where(swap, b, a))
        out.insert(1, "b", np.where(swap, a, b))
        out["score"] = 1 / (1 + np.exp(-model.logit(features))) if model else None
        return out

    kinds = "a string, b string, " + ", ".join(f"{c} double" for c in [*FEATURES, "score"])
    return spread.unionByName(known).groupBy("i", "j").applyInPandas(pairs, kinds)


def sample_absent(nodes: DataFrame, observed: DataFrame, n: int, seed: int = 42, ws: Workspace | None = None) -> DataFrame:
    """``(a, b)``: ``n`` pairs of nodes that are not observed (all of them where there are fewer), by the order of a hash.

    Pairs are drawn by hashed positions, 8 draws for each pair asked for, and more until enough are new; where fewer than
    2n pairs are absent all are listed by blocks, which are then not many more than those observed. ``observed`` is distinct.
    """
    ws = ws or Workspace(nodes.sparkSession, "absent")
    numbered = ws.table(ordered.positions(nodes.select("node"), [F.col("node")], ws=ws), "numbered")
    size, seen = numbered.count(), observed.count()
    absent = size * (size - 1) // 2 - seen
    if absent < 2 * n:
        found = absent_by_blocks(nodes, observed).select("a", "b")
    else:
        draws = 8 * n
        while True:
            end = lambda side: numbered.select(F.col("node").alias(side), F.col("position").alias(f"at_{side}"))
            drawn = nodes.sparkSession.range(draws).select(*[(hashed(F.lit(side), F.lit(seed), F.col("id")) % size).alias(f"at_{side}") for side in ("a", "b")])
            ends = drawn.join(end("a"), "at_a").join(end("b"), "at_b").where("a <> b")
            found = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(observed, ["a", "b"], "left_anti")
            found = ws.table(found, "drawn")
            if found.count() >= n:
                break
            draws *= 2
    found = found.withColumn("h", hashed(F.lit(seed), F.col("a"), F.col("b")))
    return ordered.positions(found, [F.col("h"), F.col("a"), F.col("b")], ws=ws).where(F.col("position") < n).select("a", "b")


def held_out(rows: DataFrame, keys: list[str], share: float = 0.2, label: str = "label", ws: Workspace | None = None) -> DataFrame:
    """``rows`` with ``test``: the first ``share`` of every class (rounded up) by the order of a hash of the keys."""
    found = ordered.positions(rows.withColumn("h_", hashed(*[F.col(k) for k in keys])), [F.col("h_"), *[F.col(k) for k in keys]], [label], ws=ws)
    sizes = rows.groupBy(F.col(label).alias("label_")).agg(F.count(F.lit(1)).alias("n_"))  # a row per class
    return found.join(F.broadcast(sizes), F.col(label) == F.col("label_")).withColumn("test", F.col("position") < F.ceil(F.col("n_") * share)).drop("h_", "position", "label_", "n_")


def evaluated_fit(rows: DataFrame, features: list[str], keys: list[str], ws: Workspace) -> tuple[LinkModel, float | None, float | None]:
    """A model of all ``rows`` with the AUC and average precision that one fitted on four fifths reaches on the rest.

    Measures are null where one of the parts has a single class.
    """
    split = ws.table(held_out(rows, keys, ws=ws), "split")
    auc = precision = None
    parts = split.groupBy("test").agg(F.countDistinct("label").alias("n")).collect()
    if all(p.n == 2 for p in parts) and len(parts) == 2:
        trial = fit(split.where("not test"), features)
        quality = ordered.ranking_quality(split.where("test").select("label", trial.score(features).alias("score"))).first()
        auc, precision = quality.auc, quality.average_precision
    return fit(split, features), auc, precision
