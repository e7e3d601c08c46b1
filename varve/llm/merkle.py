"""Merkle manifest of a table: one tree per group of rows, and a tree over the groups' roots.

A node is the lower-case hex SHA-256 of its children's hex texts. Leaves are dealt into aligned blocks of
``BRANCHING ** BLOCK_LEVELS`` consecutive positions, so that every block is one bounded task unit. Within a block
treehash stacks advance the authentication path leaf by leaf: they hold at most ``BRANCHING`` nodes per level while the
runs that come next are built one leaf per step. The path of the block itself is built in the same way from the
roots of the blocks, once per block, and appended to the paths of its leaves.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.operators.staging import Workspace

BRANCHING, BLOCK_LEVELS = 8, 3
BLOCK = BRANCHING**BLOCK_LEVELS
HEX = 64
#: Characters between the siblings left and right of a node, and between the levels of a path.
SIDE, LEVEL = ":", ","
_SIBLINGS = str.maketrans("", "", SIDE + LEVEL)


def node_hash(text: str) -> str:
    """Hash of concatenated hex digests.

    >>> node_hash("")[:8]
    'e3b0c442'
    """
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """SHA-256 of the columns in order, each ``-`` if null, else its number of UTF-8 bytes, ``:`` and its value as text."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left.

    >>> [height(n) for n in (0, 1, 2, 8, 9, 64, 65)]
    [0, 0, 1, 1, 2, 2, 3]
    """
    levels = 0
    while n > 1:
        n, levels = -(-n // BRANCHING), levels + 1
    return levels


class Treehash:
    """A stack that takes the leaves from ``start`` on one by one and keeps the open nodes of every level up to ``level``."""

    def __init__(self, leaves: list[str], level: int, start: int = 0):
        self.leaves, self.level, self.at = leaves, level, start
        self.open: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        """Take the next leaf, if there is one; close every run that it fills below the top level."""
        if self.at >= len(self.leaves):
            return
        self.open[0].append(self.leaves[self.at])
        self.at += 1
        for i in range(self.level):
            if len(self.open[i]) < BRANCHING:
                break
            self.open[i + 1].append(node_hash("".join(self.open[i])))
            self.open[i].clear()

    def run(self) -> list[str]:
        """The nodes of the top level; shorter runs below close as they are, which happens at the end of the leaves only."""
        for i in range(self.level):
            if self.open[i]:
                self.open[i + 1].append(node_hash("".join(self.open[i])))
                self.open[i].clear()
        return self.open[self.level]


def block_root(leaves: list[str], levels: int) -> str:
    """The node that is ``levels`` above the leaves of one block."""
    stack = Treehash(leaves, levels)
    for _ in leaves:
        stack.step()
    return stack.run()[0]


def authentication_paths(leaves: list[str], levels: int) -> Iterator[str]:
    """For each leaf in order its path: per level the siblings left and right of its ancestor."""
    span = [BRANCHING ** (i + 1) for i in range(levels)]  # leaves below one run of a level
    current = []
    for i in range(levels):
        first = Treehash(leaves, i)
        for _ in range(span[i]):
            first.step()
        current.append(first.run())
    coming = [Treehash(leaves, i, span[i]) for i in range(levels)]
    for at in range(len(leaves)):
        path = []
        for i, run in enumerate(current):
            own = at // BRANCHING**i % BRANCHING
            path.append("".join(run[:own]) + SIDE + "".join(run[own + 1 :]))
        yield LEVEL.join(path)
        for i in range(levels):
            coming[i].step()
            if (at + 1) % span[i] == 0:  # as many steps were taken as the coming run has leaves
                current[i] = coming[i].run()
                coming[i] = Treehash(leaves, i, at + 1 + span[i])


def fold(node: str, path: str) -> str:
    """The root that a node and its path lead to.

    >>> fold("ab", "")
    'ab'
    """
    for level in path.split(LEVEL) if path else ():
        left, _, right = level.partition(SIDE)
        node = node_hash(left + node + right)
    return node


def path_digest(path: str) -> str:
    """Hash of all siblings of a path, from the lowest level to the root."""
    return node_hash(path.translate(_SIBLINGS))


def _cut(digests: str) -> list[str]:
    return [digests[i : i + HEX] for i in range(0, len(digests), HEX)]


def _joined(*paths: str) -> str:
    return LEVEL.join(p for p in paths if p)


def placed(rows: DataFrame, ws: Workspace, group: str, order: list[str]) -> DataFrame:
    """``rows`` with their position ``pos`` from 0 in their group by ``order``, and the group's size ``n``.

    One range shuffle sorts; the offset of every (partition, group) comes from counts, so no group meets in one task.
    ``rows`` must be a stored table whose ``order`` has no ties that matter.
    """
    keys = [group, *order]
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row_", F.monotonically_increasing_id())
    numbered = ws.table(numbered.withColumn("part_", F.shiftright("row_", 33)), "sorted")
    counts = numbered.groupBy("part_", group).agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("count_"))
    own = Window.partitionBy(group)
    before = F.coalesce(F.sum("count_").over(own.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row per partition and group: Spark broadcasts it by its size or joins by shuffle.
    starts = ws.table(counts.select("part_", group, (before - F.col("first_")).alias("shift_"), F.sum("count_").over(own).alias("n")), "starts")
    return numbered.join(starts, ["part_", group]).withColumn("pos", F.col("row_") + F.col("shift_")).drop("part_", "row_", "shift_")


def _climb(nodes: DataFrame, ws: Workspace) -> tuple[list[DataFrame], DataFrame]:
    """From ``(group, pos, n, node, ...)`` the stored blocks of every round, lowest first, and ``(group, node)`` of the roots.

    A block row holds its nodes as one text and every further column of ``nodes`` as an array in the same order.
    """
    levels = []
    while True:
        more = [c for c in nodes.columns if c not in ("group", "pos", "n", "node")]
        row = F.struct("pos", "node", *more)
        blocks = nodes.groupBy("group", F.expr(f"pos div {BLOCK}").alias("block")).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(row)).alias("rows"))
        column = lambda c: F.transform("rows", lambda r: r[c])
        blocks = blocks.select("group", "block", "n", F.array_join(column("node"), "").alias("nodes"), *[column(c).alias(c) for c in more])
        fields = T.StructType([*blocks.schema.fields, T.StructField("root", T.StringType())])

        def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [block_root(_cut(d), min(BLOCK_LEVELS, height(n))) for d, n in zip(batch["nodes"].to_pylist(), batch["n"].to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "root"])

        blocks = ws.table(blocks.mapInArrow(rooted, fields), "blocks")
        levels.append(blocks)
        largest = blocks.agg(F.max("n")).first()[0] or 0
        if largest <= BLOCK:
            return levels, blocks.select("group", F.col("root").alias("node"))
        nodes = blocks.select("group", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("node"))


def _descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``(group, pos, path, ...)`` of the nodes in ``blocks`` from ``(group, pos, path, ...)`` of the blocks."""
    shared = [c for c in above.columns if c not in ("group", "pos", "path")]
    rows = blocks.select("group", "block", "n", "nodes").join(above.withColumnRenamed("pos", "block"), ["group", "block"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = _cut(row["nodes"])
                paths = [_joined(p, row["path"]) for p in authentication_paths(leaves, min(BLOCK_LEVELS, height(row["n"])))]
                first, k = row["block"] * BLOCK, len(leaves)
                yield pa.RecordBatch.from_pydict({"group": [row["group"]] * k, "pos": list(range(first, first + k)), "path": paths} | {c: [row[c]] * k for c in shared}, arrow)

    kinds = ["group string", "pos long", "path string", *[f"{c} string" for c in shared]]
    arrow = pa.schema([("group", pa.string()), ("pos", pa.int64()), ("path", pa.string()), *[(c, pa.string()) for c in shared]])
    return rows.mapInArrow(walk, ", ".join(kinds))


def _top(roots: DataFrame) -> DataFrame:
    return roots.select("group", F.lit(0).cast("long").alias("pos"), F.lit("").alias("path"), F.col("node").alias("root"))


def manifest(leaves: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of ``(doc_id, lang, leaf, seen)``.

    ``leaf`` is the hash that is recorded, ``seen`` the hash of the row as it is found now. Trees are built over ``leaf``;
    ``folded_root`` is what ``seen`` and the recorded siblings lead to. Leaves of a lang are ordered by doc_id (null first),
    equal ids by leaf; langs by their bytes, null first. An empty table gives an empty result.
    """
    ws = Workspace(leaves.sparkSession, "merkle")
    # A text that sorts as the lang does, with null first.
    group = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    rows = ws.table(leaves.select(group.alias("group"), "doc_id", F.col("leaf").alias("node"), "seen", F.monotonically_increasing_id().alias("tie_")), "leaves")
    lower, subroots = _climb(placed(rows, ws, "group", ["doc_id", "node", "tie_"]).drop("tie_"), ws)
    subroots = subroots.select(F.lit("").alias("group"), F.col("group").alias("lang_"), "node")
    named = ws.table(placed(ws.table(subroots, "subroots"), ws, "group", ["lang_"]), "places")
    upper, roots = _climb(named.drop("lang_"), ws)
    paths = _top(roots)
    for blocks in reversed(upper):
        paths = ws.table(_descend(blocks, paths), "paths")
    own = named.select("pos", F.col("lang_").alias("group"), F.col("node").alias("subroot"))
    paths = paths.join(own, "pos").select(own["group"], F.lit(0).cast("long").alias("pos"), "path", "root", "subroot")
    for blocks in reversed(lower[1:]):
        paths = ws.table(_descend(blocks, paths), "paths")
    return _judged(lower[0], paths)


def _judged(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """Rows of the lowest blocks with the digests of their paths and the roots that they fold to."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("doc_id").type.value_type
            arrow = pa.schema([("doc_id", ids), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
            for row in batch.to_pylist():
                leaves, k = _cut(row["nodes"]), len(row["seen"])
                proofs, folded = [], []
                for seen, path in zip(row["seen"], authentication_paths(leaves, min(BLOCK_LEVELS, height(row["n"])))):
                    path = _joined(path, row["path"])
                    proofs.append(path_digest(path))
                    folded.append(fold(seen, path))
                values = {"doc_id": row["doc_id"], "leaf": leaves, "subroot": [row["subroot"]] * k, "root": [row["root"]] * k, "proof_sha256": proofs, "folded_root": folded}
                yield pa.RecordBatch.from_pydict(values | {"verified": [f == row["root"] for f in folded]}, arrow)

    kind = dict(blocks.dtypes)["doc_id"].removeprefix("array<").removesuffix(">")
    rows = blocks.select("group", "block", "n", "nodes", "doc_id", "seen").join(above.withColumnRenamed("pos", "block"), ["group", "block"])
    return rows.mapInArrow(judge, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """``(doc_id, lang, leaf, seen)`` of documents; where ``tampered`` holds, ``seen`` is hashed with A-Z of the text in lower case.

    A null id is never tampered with; a null text stays null.
    """
    first, text = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.col("text")
    leaf = leaf_hash([*first, text])
    seen = F.when(tampered, leaf_hash([*first, lower_ascii(text)])).otherwise(leaf)
    return docs.select("doc_id", "lang", leaf.alias("leaf"), seen.alias("seen"))
