"""Components of similar sets: MinHash bands, sequential Bayesian pruning, exact verification.

Candidates meet in MinHash bands, are compared batch of hashes by batch of hashes, and are dropped
as soon as the posterior probability of reaching the threshold falls below a chosen miss
probability. Survivors are verified on their full sets. Two rounds keep a large family from being
expanded into all of its pairs: first every member of a band bucket meets the bucket's leader
only; then only members that are still in different components meet, in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.batches import sized_slices
from varve.llm.membership import Bitmap
from varve.operators.components import connected_components
from varve.operators.staging import Workspace


_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bucket keys in a range of them, which one task looks through.
PART_KEYS = 1 << 19
NODE_SCHEMA = "id long, size long, sig binary"
#: Many nodes in one row: their number, and their ids, sizes and signatures one after another.
BLOCK_SCHEMA = "n long, ids binary, sizes binary, sigs binary"


@dataclass(frozen=True)
class Banding:
    """Parameters. ``percent`` is the Jaccard threshold; ``miss`` the posterior probability at which a candidate is dropped.

    24 bands of 6 hashes miss a pair at exactly 85 % similarity with probability 1.2e-5, at 80 %
    with 5e-4, and components are usually held together by more than one link.
    """

    percent: int = 80
    bands: int = 24
    rows: int = 6
    batch: int = 24
    miss: float = 1e-5
    tile_docs: int = 256
    tile_shingles: int = 500_000
    #: Whether the column ``size`` is the exact size of the set, so that pairs are also pruned by it.
    sized: bool = True

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    def keys(self, sig: np.ndarray) -> np.ndarray:
        """One bucket key per signature and band: a hash of the band's rows whose low 5 bits are the number of the band (at most 32)."""
        parts = sig.reshape(len(sig), self.bands, self.rows).astype(np.uint64)
        h = np.full(parts.shape[:2], 0x51, dtype=np.uint64)
        for j in range(self.rows):
            h = (h ^ parts[:, :, j]) * _MIX
            h ^= h >> np.uint64(29)
        h *= _MIX
        h ^= h >> np.uint64(32)
        return ((h & ~np.uint64(31)) | np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def least_matches(self) -> list[int]:
        """After 1, 2, ... batches: the fewest matches that keep P(similarity >= threshold) at or above ``miss``.

        With a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), and its mass
        above t equals P(Binomial(n+1, t) <= m).
        """
        t, out = self.percent / 100, []
        for n in range(self.batch, self.hashes + 1, self.batch):
            mass = 0.0
            for m in range(n + 2):
                mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
                if mass >= self.miss:
                    out.append(m)
                    break
        return out


def signatures(sets: list[np.ndarray], hashes: int) -> np.ndarray:
    """16 bits of every MinHash, one row per set of 64-bit hashes; empty sets give zeros. Repeated members change nothing."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    return flat_signatures(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]), sizes, hashes)


def flat_signatures(members: np.ndarray, sizes: np.ndarray, hashes: int) -> np.ndarray:
    """:func:`signatures` of sets that lie one after another in ``members``, of 64 or 32 bits each."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2**31, hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    c = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    out = np.zeros((len(sizes), hashes), dtype=np.uint16)
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    begins = ends - sizes[full]
    # Members are well mixed; 32 bits order them.
    folded = members if members.dtype == np.uint32 else (members >> np.uint64(32)).astype(np.uint32)
    first = 0
    while first < len(full):
        # As many sets at a time as stay in the processor's cache.
        last = max(int(np.searchsorted(ends, begins[first] + (1 << 15), "right")), first + 1)
        part = folded[begins[first] : ends[last - 1]]
        at = begins[first:last] - begins[first]
        work = np.empty_like(part)
        for k in range(hashes):
            np.bitwise_xor(part, c[k], out=work)
            np.multiply(work, a[k], out=work)
            out[full[first:last], k] = np.minimum.reduceat(work, at) & np.uint32(0xFFFF)
        first = last
    return out


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted input in tables that never cut a tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tiles = batch.column("tile").to_numpy()
        if held and held[-1].column("tile")[-1].as_py() != tiles[0]:
            yield pa.Table.from_batches(held)
            held = []
        other = np.flatnonzero(tiles != tiles[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def node_block(ids: np.ndarray, sizes: np.ndarray, sig: np.ndarray) -> list[pa.Array]:
    """The columns of one row of BLOCK_SCHEMA."""
    return [pa.array([len(ids)], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes.astype(np.int64, copy=False), sig))]


def _unpacked(batches: Iterator[pa.RecordBatch], hashes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, sizes and signatures of nodes that come in blocks or one by one."""
    for batch in batches:
        if "sigs" not in batch.schema.names:
            yield batch.column("id").to_numpy(), batch.column("size").to_numpy(), _binary_matrix(batch.column("sig"), "<u2", hashes)
            continue
        for some in sized_slices([batch], 256, 1 << 22):
            ids, sizes, sig = (b"".join(some.column(c).to_pylist()) for c in ("ids", "sizes", "sigs"))
            yield np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i8"), np.frombuffer(sig, "<u2").reshape(-1, hashes)


def _cells(matrix: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    width = matrix.shape[1] * matrix.itemsize
    offsets = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, offsets, pa.py_buffer(np.ascontiguousarray(matrix).tobytes())])


def _binary_matrix(column: pa.Array | pa.ChunkedArray, dtype: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, width)


def _extremes(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, and the smallest and largest id of each."""
    if not len(keys):
        return keys, ids, ids
    order = np.argsort(keys)
    keys, ids = keys[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)


def _top(parents: dict[int, int], node: int) -> int:
    while (up := parents[node]) != node:
        parents[node] = parents[up]
        node = up
    return node


def tile_pairs(tile: np.ndarray, side: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs to compare, about ``most`` at a time: side 0 meets side 1, side 2 meets itself."""
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(tile)]]))

    def oriented(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        meets = (side[x] == 2) | (side[x] != side[y])
        x, y = x[meets], y[meets]
        turned = side[x] == 1
        return np.where(turned, y, x), np.where(turned, x, y)

    for n in np.unique(lengths):
        i, j = np.triu_indices(int(n), 1)
        if not len(i):
            continue
        begins = starts[lengths == n]
        if len(i) <= most:
            step = max(most // len(i), 1)
            for k in range(0, len(begins), step):
                some = begins[k : k + step, None]
                yield oriented((some + i).ravel(), (some + j).ravel())
        else:
            for begin in begins:
                for k in range(0, len(i), most):
                    yield oriented(begin + i[k : k + most], begin + j[k : k + most])


def prune(p: Banding, least: list[int], x: np.ndarray, y: np.ndarray, ids, group, size, sig, band) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of row numbers that survive the sequential comparison of their signatures."""
    small, large = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
    keep = (group[x] != group[y]) & (ids[x] != ids[y])
    if p.sized:
        keep &= 100 * small >= p.percent * large
    x, y = x[keep], y[keep]
    matches = np.zeros(len(x), dtype=np.int64)
    for step, low in enumerate(least):
        cols = slice(step * p.batch, (step + 1) * p.batch)
        matches += (sig[x, cols] == sig[y, cols]).sum(1)
        go_on = matches >= low
        x, y, matches = x[go_on], y[go_on], matches[go_on]
        if not len(x):
            return x, y
    # A pair belongs to the first band it shares; other bands leave it to that one.
    same = (sig[x] == sig[y]).reshape(len(x), p.bands, p.rows).all(2)
    mine = (band[x] < 0) | (same.argmax(1) == band[x])
    return x[mine], y[mine]


def similar_components(
    ws: Workspace,
    p: Banding,
    nodes: DataFrame,
    payloads_of: Callable[[DataFrame], DataFrame],
    to_sets: Callable[[list[bytes]], list[np.ndarray]],
    item: Callable[[Column], Column] = lambda node: node,
    ties: DataFrame | None = None,
) -> DataFrame:
    """``(node, component)`` of every item that is linked to another one.

    ``nodes`` has the columns of NODE_SCHEMA or of BLOCK_SCHEMA; repeated rows of an id are harmless. ``payloads_of``
    gets a table of candidate ids and returns ``(id, payload)``; ``to_sets`` turns payloads into
    sorted arrays of distinct hashes. ``item`` gives the item a node belongs to, if items have
    several nodes. ``ties`` has further links ``(src, dst)`` between items.
    """
    blocked = "sigs" in nodes.columns
    nodes = nodes.select("n", "ids", "sizes", "sigs") if blocked else nodes.select("id", "size", "sig")
    n_nodes = nodes.agg(F.sum("n") if blocked else F.count(F.lit(1))).first()[0] or 0
    parts = max(int(ws.spark.conf.get("spark.sql.shuffle.partitions")), -(-n_nodes * p.bands // PART_KEYS))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of keys and of ids, one for each range of keys; of a key that comes several times at once only the extremes."""
        for node_ids, _, sig in _unpacked(batches, p.hashes):
            found, low, high = _extremes(p.keys(sig).ravel(), np.repeat(node_ids, p.bands))
            counts = 1 + (low < high)
            keys, ids = np.repeat(found, counts), np.repeat(low, counts)
            ids[np.cumsum(counts) - 1] = high
            part = ((keys >> np.int64(32)) + np.int64(1 << 31)) * np.int64(parts) >> np.int64(32)
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, dtype=np.int64)
            offsets = pa.array(np.concatenate([cuts, [len(part)]]).astype(np.int32) * np.int32(8)).buffers()[1]
            blocks = [pa.Array.from_buffers(pa.binary(), len(cuts), [None, offsets, pa.py_buffer(x.tobytes())]) for x in (keys, ids)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), *blocks], names=["part", "keys", "ids"])

    def crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [[b"".join(b.column(c).to_pylist()) for c in ("keys", "ids")] for b in batches]
        if blocks:
            found, low, high = _extremes(*(np.frombuffer(b"".join(x), dtype=np.int64) for x in zip(*blocks)))
            two = low < high
            yield pa.RecordBatch.from_arrays([pa.array(found[two]), pa.array(low[two])], names=["key", "leader"])

    # A bucket is crowded if it has two different members. Only rows that may have a crowded key are read on.
    placed = nodes.mapInArrow(place, "part long, keys binary, ids binary").repartition(parts, "part")
    crowded = ws.table(placed.mapInArrow(crowds, "key long, leader long"), "crowded")
    known = Bitmap(crowded, "key", 128)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, sig in _unpacked(batches, p.hashes):
            keys = p.keys(sig)
            hit = known.passes(keys.ravel()).reshape(keys.shape)
            some = hit.any(1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(hit[some].sum(1))]).astype(np.int32))
            columns = [pa.array(ids[some]), pa.array(sizes[some]), _cells(sig[some]), pa.ListArray.from_arrays(offsets, pa.array(keys[hit]))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "size", "sig", "keys"])

    met = ws.table(nodes.mapInArrow(meet, f"{NODE_SCHEMA}, keys array<long>"), "met")
    buckets = met.select("id", "size", F.explode("keys").alias("key")).join(crowded, "key").distinct()
    buckets = ws.table(buckets.withColumn("band", F.pmod("key", F.lit(32)).cast("int")), "buckets")
    reps = met.join(buckets.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", "size", "sig")
    reps = ws.table(reps, "candidates")
    ws.drop(met)
    payloads = ws.table(payloads_of(reps.select("id")), "payloads")

    # Round 1: the smallest member leads its buckets and meets the others.
    led = buckets.where("id <> leader").select("leader", "id").distinct()
    per_leader = led.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    led = led.join(per_leader, "leader").select("leader", "id", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / p.tile_docs)).alias("block"))
    led = ws.table(led.withColumn("tile", F.xxhash64("leader", "block")), "led")
    tiles = led.select("tile", "id", F.lit(1).alias("side"), F.lit(-1).alias("band"), F.col("id").alias("group")).union(
        led.select("tile", F.col("leader").alias("id"), F.lit(0).alias("side"), F.lit(-1).alias("band"), F.col("leader").alias("group")).distinct()
    )
    first_links = ws.table(_link(ws, p, tiles, reps, payloads, to_sets), "links")

    # Round 2: members that are still apart meet, but for the leaders, which have met all members of their
    # buckets; the largest component of a bucket stays on one side.
    between = lambda links: links.select(item(F.col("src")).alias("src"), item(F.col("dst")).alias("dst"))
    groups = connected_components(between(first_links)).withColumnRenamed("node", "item")
    grouped = buckets.where("id <> leader").withColumn("item", item(F.col("id"))).join(groups, "item", "left").withColumn("group", F.coalesce("component", "item"))
    sizes = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    split = (
        sizes.groupBy("key")
        .agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "group", "s")).alias("major"), F.sum("n").alias("total"), F.sum("s").alias("total_s"))
        .where("groups > 1")
    )
    blocks = lambda n, s: F.greatest(F.lit(1), F.ceil(n / p.tile_docs), F.ceil(s / p.tile_shingles)).cast("int")
    split = split.select(
        "key",
        F.col("major.group").alias("major"),
        blocks(F.col("total") - F.col("major.n"), F.col("total_s") - F.col("major.s")).alias("minor_blocks"),
        blocks(F.col("major.n"), F.col("major.s")).alias("major_blocks"),
    )
    apart = grouped.join(split, "key").drop("component", "item", "leader")
    is_major = F.col("group") == F.col("major")
    block = F.when(is_major, F.col("minor_blocks") + F.pmod(F.xxhash64("id"), F.col("major_blocks"))).otherwise(
        F.pmod(F.xxhash64("id"), F.col("minor_blocks"))
    )
    apart = apart.withColumn("block", block.cast("int"))
    last = F.col("minor_blocks") + F.col("major_blocks") - 1
    meets = F.when(is_major, F.sequence(F.lit(0), F.col("minor_blocks") - 1)).otherwise(F.sequence(F.lit(0), last))
    tiled = apart.withColumn("other", F.explode(meets))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") == low, 0).otherwise(1)
    tiles = tiled.select(F.xxhash64("key", low, high).alias("tile"), "id", side.alias("side"), "band", "group")
    links = between(first_links.union(_link(ws, p, tiles, reps, payloads, to_sets)))
    links = ws.table(links if ties is None else links.union(ties.select("src", "dst")), "all-links")
    return ws.table(connected_components(links), "components")


def _link(ws: Workspace, p: Banding, tiles: DataFrame, reps: DataFrame, payloads: DataFrame, to_sets: Callable) -> DataFrame:
    """Verified links ``(src, dst)`` among the rows of each tile, enough to join what is linked: sequential pruning, then exact comparison."""
    least = p.least_matches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            tile, ids, group, side, size, band = (t.column(c).to_numpy() for c in ("tile", "id", "group", "side", "size", "band"))
            sig = _binary_matrix(t.column("sig"), "<u2", p.hashes)
            kept = [prune(p, least, x, y, ids, group, size, sig, band) for x, y in tile_pairs(tile, side)]
            xs, ys = (np.concatenate([np.zeros(0, dtype=np.int64), *part]) for part in zip(*kept)) if kept else (np.zeros(0, dtype=np.int64),) * 2
            if len(xs):
                order = np.argsort(xs, kind="stable")
                xs, ys = xs[order], ys[order]
                involved = np.union1d(xs, ys)
                counts = np.bincount(np.searchsorted(involved, xs), minlength=len(involved))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[ys], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile[involved], pa.int64()), pa.array(ids[involved], pa.int64()), partners], names=["tile", "id", "partners"]
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches):
            tile = t.column("tile").to_numpy()
            cuts = [*np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])).tolist(), len(tile)]
            src, dst, first = [], [], 0
            while first < len(cuts) - 1:
                # Whole tiles of some hundred rows at a time, so that few sets are alive.
                last = first + 1
                while last < len(cuts) - 1 and cuts[last + 1] - cuts[first] <= 512:
                    last += 1
                part = t.slice(cuts[first], cuts[last] - cuts[first])
                ids = part.column("id").to_pylist()
                sets = dict(zip(ids, to_sets(part.column("payload").to_pylist()), strict=True))
                known = {a: a for a in ids}  # pairs that links of these rows already join need no check
                for a, partners in zip(ids, part.column("partners").to_pylist(), strict=True):
                    for b in partners:
                        top_a, top_b = _top(known, a), _top(known, b)
                        if top_a == top_b:
                            continue
                        x, y = sets[a], sets[b]
                        merged = np.concatenate([x, y])
                        merged.sort(kind="stable")
                        both = np.count_nonzero(merged[1:] == merged[:-1])
                        if 100 * both >= p.percent * (len(x) + len(y) - both):
                            src.append(a)
                            dst.append(b)
                            known[top_a] = top_b
                first = last
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    # A fixed number of tasks: by their bytes alone these compute-heavy rows would be put into few.
    tasks = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tiles.join(reps, "id").select("tile", "id", "side", "band", "group", "size", "sig")
    survivors = ws.table(rows.repartition(tasks, "tile").sortWithinPartitions("tile", "id").mapInArrow(compare, "tile long, id long, partners array<long>"), "survivors")
    rows = survivors.join(payloads, "id").select("tile", "id", "partners", "payload")
    return rows.repartition(tasks, "tile").sortWithinPartitions("tile").mapInArrow(verify, "src long, dst long")
