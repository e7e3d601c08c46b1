"""Gaussian hidden Markov models over many ordered sequences, as a scan over chunks.

A sequence is cut into chunks of bounded length. A chunk acts on what precedes it as a K x K matrix, and such matrices
combine associatively: sums of products for likelihoods, maxima for paths. Products are formed in groups of ``FAN`` chunks,
level by level, and then the message that enters a chunk from either side is handed down. So neither the length of a
sequence nor their number is bounded by a task, and many models (numbers of states, starts) share one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import ordered
from varve.operators.staging import Workspace

#: Matrices that one task multiplies, and chunks that are worked on at a time in a task.
FAN, SLICE = 64, 256
LOW = -1e300


@dataclass(frozen=True)
class Hmm:
    """Start probabilities (K), transitions (K, K), means and variances (K, d) of independent normal values."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @property
    def states(self) -> int:
        return len(self.start)

    @property
    def free_parameters(self) -> int:
        k, d = self.mean.shape
        return k - 1 + k * (k - 1) + 2 * k * d

    def emission(self, x: np.ndarray) -> np.ndarray:
        """Log densities of ``x`` (..., d) in every state (..., K)."""
        z = (x[..., None, :] - self.mean) ** 2 / self.var + np.log(2 * np.pi * self.var)
        return -0.5 * z.sum(-1)


def _log(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.log(np.where(p > 0, p, 1)), LOW)


def _add(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials."""
    top = np.maximum(x.max(axis=axis, keepdims=True), LOW)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _best(x: np.ndarray, axis: int) -> np.ndarray:
    return x.max(axis=axis)


def _times(a: np.ndarray, b: np.ndarray, reduce: Callable) -> np.ndarray:
    """Product of (..., K, K) matrices of logarithms."""
    return reduce(a[..., :, :, None] + b[..., None, :, :], axis=-2)


def chunked(rows: DataFrame, sequence: str, order: list[str], values: list[str], length: int = 256, ws: Workspace | None = None) -> DataFrame:
    """``(sequence, chunk, n_chunks, keys, x)``, stored: per chunk the last of ``order`` and the values of its rows, row by row.

    ``order`` must be unique within a sequence. Rows with a null value go; a null sequence is one sequence of its own.
    """
    ws = ws or Workspace(rows.sparkSession, "states")
    usable = rows.where(" and ".join(f"{c} is not null" for c in values)).select(F.col(sequence).cast("string").alias("sequence"), *order, *values)
    placed = ordered.positions(usable, [F.col(c) for c in order], ["sequence"], ws=ws)
    row = F.struct("position", F.col(order[-1]).alias("key"), F.array(*[F.col(c).cast("double") for c in values]).alias("x"))
    found = placed.groupBy("sequence", F.expr(f"position div {length}").alias("chunk")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    found = ws.table(found.select(F.coalesce("sequence", F.lit("\u0000null")).alias("sequence"), "chunk", F.transform("rows", lambda r: r["key"]).alias("keys"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x")), "chunks")
    sizes = found.groupBy("sequence").agg((F.max("chunk") + 1).alias("n_chunks"))
    return ws.table(spread(found.join(sizes, "sequence")), "sized")


def spread(chunks: DataFrame) -> DataFrame:
    """Chunks dealt to as many tasks as the cluster runs at once: they are few bytes for much work, which Spark would put in one task."""
    return chunks.repartition(chunks.sparkSession.sparkContext.defaultParallelism)


def _tensor(part: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (C, L, d), 0 beyond the end of a chunk, and the lengths."""
    sizes = np.array([len(x) // d for x in part["x"]])
    x = np.zeros((len(part), int(sizes.max()), d))
    for i, v in enumerate(part["x"]):
        x[i, : sizes[i]] = np.asarray(v, dtype=float).reshape(-1, d)
    return x, sizes


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            yield batch.iloc[at : at + SLICE]


def _matrices(x: np.ndarray, sizes: np.ndarray, first: np.ndarray, m: Hmm, reduce: Callable) -> np.ndarray:
    """What each chunk does to the message before it. At the head of a sequence only the message's first entry counts."""
    move, b = _log(m.move), m.emission(x)
    steps = move + b[:, :, None, :]
    head = np.full((m.states, m.states), LOW)
    head[0] = _log(m.start)
    steps[first, 0] = head + b[first, 0][:, None, :]
    out = steps[:, 0]
    for t in range(1, x.shape[1]):
        out = np.where((t < sizes)[:, None, None], _times(out, steps[:, t], reduce), out)
    return out


def _messages(chunks: DataFrame, models: list[Hmm], reduce: Callable, ws: Workspace) -> DataFrame | None:
    """``(sequence, chunk, messages)``: for every model (model, before, after) as logarithms; None if no sequence has two chunks."""
    longest = chunks.agg(F.max("n_chunks")).first()[0] or 0
    if longest <= 1:
        return None
    d = models[0].mean.shape[1]
    shape = "model int, sequence string, at long, matrix array<double>"

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            x, sizes = _tensor(part, d)
            for i, m in enumerate(models):
                found = _matrices(x, sizes, (part["chunk"] == 0).to_numpy(), m, reduce)
                yield pd.DataFrame({"model": i, "sequence": part["sequence"].to_numpy(), "at": part["chunk"].to_numpy(), "matrix": list(found.reshape(len(part), -1))})

    def product(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        k = models[int(group["model"].iloc[0])].states
        out = None
        for v in group["matrix"]:
            m = np.asarray(v).reshape(k, k)
            out = m if out is None else _times(out, m, reduce)
        return pd.DataFrame({"model": group["model"].iloc[:1], "sequence": group["sequence"].iloc[:1], "at": group["at"].iloc[:1] // FAN, "matrix": [out.ravel()]})

    def hand_down(key: tuple, inner: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        inner = inner.sort_values("at")
        k = models[int(key[0])].states
        ms = [np.asarray(v).reshape(k, k) for v in inner["matrix"]]
        before, after = [np.asarray(outer["before"].iloc[0])], [np.asarray(outer["after"].iloc[0])]
        for m in ms[:-1]:
            before.append(reduce(before[-1][:, None] + m, axis=0))
        for m in ms[:0:-1]:
            after.append(reduce(m + after[-1][None, :], axis=1))
        return pd.DataFrame({"model": inner["model"], "sequence": inner["sequence"], "at": inner["at"], "before": before, "after": after[::-1]})

    levels = [ws.table(chunks.mapInPandas(matrices, shape), "matrices")]
    while longest > FAN:
        longest = -(-longest // FAN)
        levels.append(ws.table(levels[-1].groupBy("model", "sequence", F.expr(f"at div {FAN}").alias("up")).applyInPandas(product, shape), "matrices"))
    sequences = levels[-1].select("model", "sequence").distinct()
    k = F.element_at(F.array(*[F.lit(m.states) for m in models]), F.col("model") + 1)
    outer = sequences.select("model", "sequence", F.lit(0).cast("long").alias("at"), F.transform(F.sequence(F.lit(1), k), lambda i: F.when(i == 1, 0.0).otherwise(LOW)).alias("before"), F.array_repeat(F.lit(0.0), k).alias("after"))
    for level in reversed(levels):
        up = level.groupBy("model", "sequence", F.expr(f"at div {FAN}").alias("up"))
        outer = up.cogroup(outer.withColumnRenamed("at", "up").groupBy("model", "sequence", "up")).applyInPandas(hand_down, "model int, sequence string, at long, before array<double>, after array<double>")
        outer = ws.table(outer, "messages")
    return outer.groupBy("sequence", F.col("at").alias("chunk")).agg(F.collect_list(F.struct("model", "before", "after")).alias("messages"))


def _entering(part: pd.DataFrame, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Messages of model ``i`` for the chunks of a slice: of a whole sequence those of its two ends."""
    if "messages" not in part:
        before = np.full((len(part), k), LOW)
        before[:, 0] = 0
        return before, np.zeros((len(part), k))
    own = [next(m for m in ms if m["model"] == i) for ms in part["messages"]]
    return np.array([m["before"] for m in own]), np.array([m["after"] for m in own])


def _forward(x: np.ndarray, sizes: np.ndarray, first: np.ndarray, before: np.ndarray, m: Hmm, reduce: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Log densities b (C, L, K) and forward messages (C, L, K); beyond the end the last one is repeated."""
    b, move = m.emission(x), _log(m.move)
    ahead = np.empty_like(b)
    ahead[:, 0] = np.where(first[:, None], _log(m.start), reduce(before[:, :, None] + move, axis=1)) + b[:, 0]
    for t in range(1, x.shape[1]):
        ahead[:, t] = np.where((t < sizes)[:, None], reduce(ahead[:, t - 1, :, None] + move, axis=1) + b[:, t], ahead[:, t - 1])
    return b, ahead


def _statistics(part: pd.DataFrame, i: int, m: Hmm) -> np.ndarray:
    """Log likelihood of the sequences that begin here, and expected counts: starts, moves, rows, sums and sums of squares by state."""
    k, d = m.mean.shape
    x, sizes = _tensor(part, d)
    first = (part["chunk"] == 0).to_numpy()
    before, after = _entering(part, i, k)
    b, ahead = _forward(x, sizes, first, before, m, _add)
    move = _log(m.move)
    behind = np.empty_like(b)
    behind[:, -1] = after
    for t in range(x.shape[1] - 2, -1, -1):
        behind[:, t] = np.where((t + 1 < sizes)[:, None], _add(move + (b[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), after)
    total = _add(ahead[:, -1] + after, axis=1)
    inside = np.arange(x.shape[1])[None, :] < sizes[:, None]
    share = np.where(inside[..., None], np.exp(ahead + behind - total[:, None, None]), 0)
    moved = np.zeros((k, k))
    entry = np.exp(before[:, :, None] + move + (b[:, 0] + behind[:, 0] - total[:, None])[:, None, :])
    moved += entry[~first].sum(0)
    for t in range(1, x.shape[1]):
        on = t < sizes
        if on.any():
            moved += np.exp(ahead[on, t - 1][:, :, None] + move + (b[on, t] + behind[on, t] - total[on, None])[:, None, :]).sum(0)
    flat, w = x.reshape(-1, d), share.reshape(-1, k)
    return np.concatenate([[total[first].sum()], share[first, 0].sum(0), moved.ravel(), w.sum(0), (w.T @ flat).ravel(), (w.T @ flat**2).ravel()])


def expectation(chunks: DataFrame, models: list[Hmm], ws: Workspace) -> list[np.ndarray]:
    """Per model the sums of ``_statistics`` over all chunks; only these sums reach the driver."""
    messages = _messages(chunks, models, _add, ws)
    rows = chunks if messages is None else spread(chunks.join(messages, ["sequence", "chunk"]))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [0.0] * len(models)
        any_ = False
        for part in _slices(batches):
            any_ = True
            found = [f + _statistics(part, i, m) for i, (f, m) in enumerate(zip(found, models, strict=True))]
        if any_:
            yield pd.DataFrame({"model": range(len(models)), "sums": found})

    parts = rows.mapInPandas(sums, "model int, sums array<double>").select("model", F.posexplode("sums").alias("at", "x"))
    out = [np.zeros(1 + m.states + m.states**2 + m.states + 2 * m.mean.size) for m in models]
    for r in parts.groupBy("model", "at").agg(F.sum("x").alias("x")).collect():
        out[r.model][r["at"]] = r.x
    return out


def maximisation(sums: np.ndarray, m: Hmm, floor: np.ndarray) -> Hmm:
    """The model that the expected counts ask for; variances are at least ``floor``, a state without rows keeps its values."""
    k, d = m.mean.shape
    cuts = np.cumsum([1, k, k * k, k, k * d])
    _, starts, moves, rows, sums_x, squares = np.split(sums, cuts)
    moves, sums_x, squares = moves.reshape(k, k), sums_x.reshape(k, d), squares.reshape(k, d)
    used = rows[:, None] > 1e-12
    weight = np.maximum(rows, 1e-12)[:, None]
    mean = np.where(used, sums_x / weight, m.mean)
    var = np.where(used, np.maximum(squares / weight - mean**2, floor), m.var)
    left = moves.sum(1, keepdims=True)
    move = np.where(left > 1e-12, moves / np.maximum(left, 1e-12), m.move)
    return Hmm(starts / max(starts.sum(), 1e-300), move, mean, var)


def fit(chunks: DataFrame, models: list[Hmm], max_rounds: int = 60, tolerance: float = 1e-6, ws: Workspace | None = None) -> list[tuple[Hmm, float]]:
    """Every start after expectation and maximisation until its log likelihood gains less than ``tolerance`` of itself, with that likelihood.

    All starts that have not settled share one pass per round. ``chunks`` is stored and not empty.
    """
    ws = ws or Workspace(chunks.sparkSession, "states")
    _, _, spread = moments(chunks, models[0].mean.shape[1])
    floor = 1e-3 * np.maximum(spread, 1e-12)
    current, reached = list(models), [-np.inf] * len(models)
    open_ = list(range(len(models)))
    for _ in range(max_rounds):
        found = expectation(chunks, [current[i] for i in open_], ws)
        still = []
        for i, sums in zip(open_, found, strict=True):
            gain, reached[i] = sums[0] - reached[i], float(sums[0])
            if gain > tolerance * max(abs(reached[i]), 1):
                current[i] = maximisation(sums, current[i], floor)
                still.append(i)
        open_ = still
        if not open_:
            break
    return list(zip(current, log_likelihood(chunks, current, ws) if open_ else reached, strict=True))


def log_likelihood(chunks: DataFrame, models: list[Hmm], ws: Workspace) -> list[float]:
    return [float(s[0]) for s in expectation(chunks, models, ws)]


def moments(chunks: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, and mean and variance of every value."""
    values = chunks.select(F.posexplode("x").alias("at", "v")).groupBy((F.col("at") % d).alias("at")).agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s")).orderBy("at").collect()
    return (values[0].n if values else 0), np.array([v.m for v in values]), np.array([v.s for v in values])


def starts(chunks: DataFrame, states: int, n: int, d: int) -> list[Hmm]:
    """``n`` models to start from: means at rows chosen by a hash, the variance of all rows, states that last."""
    _, _, spread = moments(chunks, d)
    rows = chunks.select("sequence", F.posexplode("keys").alias("at", "key"), "x")
    row = rows.select(F.md5(F.concat_ws("|", "sequence", F.col("key").cast("string"))).alias("h"), F.slice("x", F.col("at") * d + 1, d).alias("v"))
    chosen = [r.v for r in row.orderBy("h", "v").limit(states * n).collect()]  # a bounded number of rows
    move = np.full((states, states), 0.2 / max(states - 1, 1))
    np.fill_diagonal(move, 0.8 if states > 1 else 1.0)
    pick = lambda s, k: chosen[(s * states + k) % len(chosen)]
    return [Hmm(np.full(states, 1 / states), move, np.array([pick(s, k) for k in range(states)]), np.tile(np.maximum(spread, 1e-12), (states, 1))) for s in range(n)]


def decode(chunks: DataFrame, m: Hmm, ws: Workspace | None = None) -> DataFrame:
    """``(sequence, key, state, posterior)``: the most probable path, from 1, and the probability of that state in its place.

    Where several paths are equally probable, chunks may follow different ones. An empty table gives no rows.
    """
    ws = ws or Workspace(chunks.sparkSession, "states")
    rows = chunks
    for name, reduce in (("best", _best), ("all_", _add)):
        messages = _messages(chunks, [m], reduce, ws)
        if messages is not None:
            rows = spread(rows.join(messages.withColumnRenamed("messages", name), ["sequence", "chunk"]))
    d = m.mean.shape[1]
    key = chunks.schema["keys"].dataType.elementType.simpleString()

    def paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches):
            x, sizes = _tensor(part, d)
            first = (part["chunk"] == 0).to_numpy()
            named = lambda c: part.rename(columns={c: "messages"}) if c in part else part
            before, after = _entering(named("best"), 0, m.states)
            _, ahead = _forward(x, sizes, first, before, m, _best)
            state = np.zeros(x.shape[:2], dtype=np.int64)
            rank = np.arange(len(part))
            state[rank, sizes - 1] = (ahead[:, -1] + after).argmax(1)
            move = _log(m.move)
            for t in range(x.shape[1] - 2, -1, -1):
                back = (ahead[:, t] + move[:, state[:, t + 1]].T).argmax(1)
                state[:, t] = np.where(t + 1 < sizes, back, state[:, t])
            before, after = _entering(named("all_"), 0, m.states)
            b, ahead = _forward(x, sizes, first, before, m, _add)
            total = _add(ahead[:, -1] + after, axis=1)
            behind = np.empty_like(b)
            behind[:, -1] = after
            for t in range(x.shape[1] - 2, -1, -1):
                behind[:, t] = np.where((t + 1 < sizes)[:, None], _add(move + (b[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2), after)
            share = np.exp(ahead + behind - total[:, None, None])
            for i, row in enumerate(part.itertuples(index=False)):
                n = sizes[i]
                yield pd.DataFrame({"sequence": row.sequence, "key": list(row.keys), "state": state[i, :n] + 1, "posterior": share[i, np.arange(n), state[i, :n]]})

    return rows.mapInPandas(paths, f"sequence string, key {key}, state int, posterior double")
