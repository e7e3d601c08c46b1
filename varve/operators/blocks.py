"""Products of all pairs of rows of a core, block by block, so that only what a task keeps of them leaves it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of two blocks that a task may hold, which bounds the rows of a block by the number of samples.
BLOCK_VALUES = 1 << 22
#: Nodes of a core up to which products are summed over slices of labels.
SLICED_NODES = 2048


def by_blocks(rows: DataFrame, values: int, work: Callable, kinds: str, block_values: int) -> DataFrame:
    """``work(core, left, right, same)`` on every pair of blocks of a core; ``values`` is the number of doubles of a row."""
    n = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_blocks = max(-(-n // max(block_values // (2 * max(values, 1)), 1)), 1)
    spread = rows.withColumn("own_", F.pmod(F.xxhash64("node"), F.lit(n_blocks)).cast("int")).withColumn("other_", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    spread = spread.select(F.col("core").alias("core_"), F.least("own_", "other_").alias("i_"), F.greatest("own_", "other_").alias("j_"), "own_", *[c for c in rows.columns if c != "core"])
    columns = [part.strip().split(" ")[0] for part in kinds.split(",")]

    def apply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        core, i, j = key
        group = group.sort_values("node")
        left, right = group[group["own_"] == i], group[group["own_"] == j]
        found = work(core, left, right, i == j) if len(left) and len(right) else None
        return pd.DataFrame(columns=columns, dtype=object) if found is None else found

    return spread.groupBy("core_", "i_", "j_").applyInPandas(apply, kinds)


def pair_sums(rows: DataFrame, values: int, block_values: int) -> DataFrame:
    """``(core, src, dst, n, r)``: shared labels and dot product of all pairs of a core's nodes, summed over slices of the labels.

    Rows as in ``products``; ``values`` is the length of the longest. A slice holds a bounded number of values of all nodes, so
    the work grows with the number of labels, where blocks of ever fewer whole rows meet in ever more tasks.
    """
    nodes = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    n_slices = max(-(-2 * values * nodes // block_values), 1)
    slice_ = F.pmod(F.xxhash64("e.labels"), F.lit(n_slices)).cast("int")
    cells = rows.select("core", "node", F.explode(F.arrays_zip("labels", "x")).alias("e")).select("core", slice_.alias("slice_"), "node", "e")
    # One shuffle serves both groupings.
    parts = cells.repartition("core", "slice_").groupBy("core", "slice_", "node").agg(F.collect_list("e").alias("e"))
    parts = parts.select("core", "slice_", "node", F.col("e.labels").alias("labels"), F.col("e.x").alias("x"))

    def work(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        names, at = group["node"].to_numpy(), np.repeat(np.arange(len(group)), [len(v) for v in group["x"]])
        _, column = np.unique(np.concatenate(group["labels"].tolist()), return_inverse=True)
        x, there = np.zeros((len(names), column.max() + 1)), np.zeros((len(names), column.max() + 1))
        x[at, column], there[at, column] = np.concatenate(group["x"].tolist()), 1
        p, q = np.triu_indices(len(names), 1)
        n = (there @ there.T)[p, q]
        kept = n > 0
        p, q = p[kept], q[kept]
        return pd.DataFrame({"core": group["core"].iloc[0], "src": names[p], "dst": names[q], "n": n[kept].astype(int), "r": (x @ x.T)[p, q]})

    parts = parts.groupBy("core", "slice_").applyInPandas(work, "core string, src string, dst string, n long, r double")
    return parts.groupBy("core", "src", "dst").agg(F.sum("n").alias("n"), F.sum("r").alias("r"))


def aligned(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of both blocks over all their labels, 0 where a row lacks one, and masks of what is there."""
    labels = {k: i for i, k in enumerate(sorted({k for side in (left, right) for ks in side["labels"] for k in ks}))}

    def dense(side: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        x, there = np.zeros((len(side), len(labels))), np.zeros((len(side), len(labels)))
        for i, (ks, v) in enumerate(zip(side["labels"], side["x"])):
            at = [labels[k] for k in ks]
            x[i, at], there[i, at] = v, 1
        return x, there

    (x, a), (y, b) = dense(left), dense(right)
    return x, y, a, b


def products(rows: DataFrame, min_shared: int, cutoff: float | None = None, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``(core, src, dst, n, r)``: dot product r over the n labels that two nodes of a core share, src < dst.

    ``rows`` is a stored ``(core, node, labels array, x array<double>)`` without nulls. Pairs with fewer than ``min_shared``
    labels go, and with a ``cutoff`` those with a smaller absolute product.
    """
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    nodes = rows.groupBy("core").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # Long rows of few nodes: sums over slices of labels, of which there are as many as the rows fill. A slice tells nodes^2 / 2 sums.
    if 4 * longest * nodes > block_values and nodes <= SLICED_NODES:
        found = pair_sums(rows, longest, block_values).where(F.col("n") >= min_shared)
        return found if cutoff is None else found.where(F.abs("r") >= cutoff)

    def work(core: str, left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame | None:
        x, y, in_x, in_y = aligned(left, right)
        r, n = x @ y.T, in_x @ in_y.T
        kept = n >= min_shared
        if cutoff is not None:
            kept &= np.abs(r) >= cutoff
        if same:
            kept &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
        p, q = np.nonzero(kept)
        if not len(p):
            return None
        a, b = left["node"].to_numpy()[p], right["node"].to_numpy()[q]
        swap = a > b
        return pd.DataFrame({"core": [core] * len(p), "src": np.where(swap, b, a).tolist(), "dst": np.where(swap, a, b).tolist(), "n": n[p, q].astype(int), "r": r[p, q]})

    return by_blocks(rows, 2 * longest, work, "core string, src string, dst string, n long, r double", block_values)
