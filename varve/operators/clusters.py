"""Clusters of vectors: exact silhouettes by blocks, k-means with a chosen number of clusters, principal components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators.staging import Workspace

SEED = 42


def silhouettes(points: DataFrame, counts: list[int], block_rows: int = 1024) -> DataFrame:
    """``(id, silhouettes)`` of ``(id, z array<double>, labels array<int>)``, one value per clustering.

    ``labels[c]`` is from 0 to ``counts[c] - 1``. Points are dealt into blocks by hash; each pair of blocks is one matrix of
    Euclid distances, computed once for all clusterings, from which only sums per point and cluster leave the task. A point
    alone in its cluster, or without another cluster, has 0. Ids are unique; a null vector takes no part.
    """
    usable = points.where("id is not null and z is not null").select(F.col("id").cast("string").alias("id"), "z", "labels")
    n_blocks = max(-(-usable.count() // block_rows), 1)
    own = F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")
    spread = usable.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    spread = spread.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "z", "labels")
    total = sum(counts)
    names = [f"s{k}" for k in range(total)]

    def members(labels: np.ndarray) -> np.ndarray:
        """Points x clusters of all clusterings, 1 for membership."""
        out, at = np.zeros((len(labels), total)), 0
        for c, n in enumerate(counts):
            out[np.arange(len(labels)), at + labels[:, c]] = 1
            at += n
        return out

    def sums(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i, j = key
        sides = [rows[rows["own"] == b] for b in ((i,) if i == j else (i, j))]
        sides = [s for s in sides if len(s)]
        out = []
        pairs = [(sides[0], sides[0])] if i == j and sides else [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []
        for a, b in pairs:
            x, y = np.array(a["z"].tolist(), dtype=float), np.array(b["z"].tolist(), dtype=float)
            in_cluster = members(np.array(b["labels"].tolist()))
            # Differences rather than dot products: equal vectors are at exactly 0. Rows in steps that bound the memory.
            step = max((1 << 22) // max(y.size, 1), 1)
            found = np.concatenate([np.sqrt(((x[k : k + step, None, :] - y[None, :, :]) ** 2).sum(2)) @ in_cluster for k in range(0, len(x), step)])
            out.append((a["id"].tolist(), found))
        if not out:
            return pd.DataFrame(columns=["id", *names], dtype=object)
        frame = pd.DataFrame(np.concatenate([f for _, f in out]), columns=names)
        frame.insert(0, "id", [i for ids, _ in out for i in ids])
        return frame

    kinds = "id string, " + ", ".join(f"{n} double" for n in names)
    far = spread.groupBy("i", "j").applyInPandas(sums, kinds).groupBy("id").agg(*[F.sum(n).alias(n) for n in names])
    sizes = usable.select(F.posexplode("labels").alias("c", "label")).groupBy("c", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per cluster
    size = {(r.c, r.label): r.n for r in sizes}

    def value(c: int, first: int) -> F.Column:
        label = F.col("labels")[c]
        mean = lambda k, less: F.lit(None).cast("double") if size.get((c, k), 0) - less <= 0 else F.col(f"s{first + k}") / float(size[c, k] - less)
        ks = range(counts[c])
        a = F.coalesce(*[F.when(label == k, mean(k, 1)) for k in ks])
        others = [F.when(label != k, mean(k, 0)) for k in ks]
        b = F.least(*others) if len(others) > 1 else others[0]
        return F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))

    firsts = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return far.join(usable.select("id", "labels"), "id").select("id", F.array(*[value(c, firsts[c]) for c in range(len(counts))]).alias("silhouettes"))


def k_means(points: DataFrame, ks: list[int], seed: int = SEED) -> tuple[DataFrame, dict[int, float]]:
    """``points`` with ``labels``: a k-means label for every k; and the within-cluster sum of squares by k.

    ``points`` is stored and holds ``z``; the fits read it once per iteration.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    table = points.withColumn("features", array_to_vector("z"))
    cost = {}
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol=f"label_{k}", maxIter=100, tol=1e-6).fit(table)
        cost[k] = float(model.summary.trainingCost)
        table = model.transform(table)
    return table.select(*points.columns, F.array(*[F.col(f"label_{k}") for k in ks]).alias("labels")), cost


def chosen_k_means(points: DataFrame, k_max: int = 8, ws: Workspace | None = None) -> tuple[DataFrame, DataFrame]:
    """``(id, cluster, silhouette, mean_silhouette, n_clusters)`` by the k of 2 to ``k_max`` with the largest mean silhouette, and ``(k, silhouette)``.

    The first of equal means wins. With under three points there is one cluster and no silhouette.
    """
    ws = ws or Workspace(points.sparkSession, "clusters")
    stored = ws.table(points.where("id is not null and z is not null").select(F.col("id").cast("string").alias("id"), "z").orderBy("id"), "points")
    n = stored.count()
    if n < 3:
        none = F.lit(None).cast("double")
        return stored.select("id", F.lit(0).alias("cluster"), none.alias("silhouette"), none.alias("mean_silhouette"), F.lit(1).alias("n_clusters")), stored.sparkSession.createDataFrame([], "k int, silhouette double")
    ks = list(range(2, max(2, min(k_max, n - 1)) + 1))
    labelled = ws.table(k_means(stored, ks)[0], "labelled")
    found = ws.table(silhouettes(labelled, ks), "silhouettes")
    means = found.agg(*[F.avg(F.col("silhouettes")[i]).alias(str(k)) for i, k in enumerate(ks)]).first()
    best = 0
    for i in range(1, len(ks)):
        if means[i] > means[best]:
            best = i
    rows = labelled.select("id", F.col("labels")[best].alias("cluster")).join(found.select("id", F.col("silhouettes")[best].alias("silhouette")), "id")
    table = stored.sparkSession.createDataFrame([(k, float(means[i])) for i, k in enumerate(ks)], "k int, silhouette double")
    return rows.withColumns({"mean_silhouette": F.lit(float(means[best])), "n_clusters": F.lit(ks[best])}), table


def components(points: DataFrame, k: int = 2) -> tuple[DataFrame, list[float]]:
    """``(id, scores)`` on the first k principal components of centred vectors, and the shares of variance they explain.

    Only the covariance of the values (their number squared) meets on the driver. The largest loading of a component is positive.
    """
    usable = points.where("id is not null and z is not null")
    first = usable.select(F.size("z").alias("d")).first()
    if first is None:
        return points.limit(0).select("id", F.array(F.lit(0.0)).alias("scores")), []
    d = first.d

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, any_ = np.zeros((d + 1, d + 1)), False
        for batch in batches:
            if len(batch):
                x = np.hstack([np.array(batch["z"].tolist(), dtype=float), np.ones((len(batch), 1))])
                out, any_ = out + x.T @ x, True
        if any_:
            yield pd.DataFrame({"at": np.arange(out.size), "x": out.ravel()})

    cells = usable.select("z").mapInPandas(gram, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((d + 1) ** 2)
    for r in cells:
        m[r["at"]] = r.x
    m = m.reshape(d + 1, d + 1)
    n, mean = m[d, d], m[d, :d] / m[d, d]
    covariance = m[:d, :d] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[: min(k, d)]
    loads = vectors[:, order] * np.sign(vectors[np.abs(vectors[:, order]).argmax(0), order])
    score = lambda c: F.aggregate(F.zip_with("z", F.array(*[F.lit(float(v)) for v in loads[:, c]]), lambda p, q: p * q), F.lit(-float(mean @ loads[:, c])), lambda s, p: s + p)
    total = max(float(np.trace(covariance)), 1e-300)
    return usable.select("id", F.array(*[score(c) for c in range(loads.shape[1])]).alias("scores")), [float(v) / total for v in values[order]]
