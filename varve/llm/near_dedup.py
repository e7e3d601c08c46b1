"""MinHash near-duplicate documents.

Exact copies collapse to one representative; representatives are linked on their word shingles by
the banded candidates, sequential Bayesian verification and exact check of :mod:`varve.llm.minhash`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.batches import slices
from varve.llm.membership import Bitmap
from varve.llm.minhash import Banding, signatures, similar_components
from varve.operators.staging import Workspace

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class NearDedup(Banding):
    """Banding of documents; ``shingle`` is the number of words in a shingle."""

    shingle: int = 5


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and U+0009-U+000D, A-Z lower-cased; none for null."""
    return text.encode().lower().split() if text else []


def shingle_set(tokens: list[bytes], k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none make an empty set."""
    n = len(tokens)
    if n < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), n)] if n else [], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=n)
    h = w[: n - k + 1].copy()
    for j in range(1, k):
        h = ((h ^ (h >> np.uint64(29))) * _MIX) ^ w[j : n - k + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return np.unique(h ^ (h >> np.uint64(31)))


def _copy_of(tokens: list[bytes]) -> bytes:
    """Texts with the same words in the same order are copies."""
    return hashlib.md5(b" ".join(tokens)).digest()


def near_duplicates(docs: DataFrame, params: NearDedup = NearDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents are linked when 100 * |A and B| >= percent * |A or B| over their shingle sets;
    component_id is the smallest id that links reach. Null and empty texts have no shingles and
    are linked with nothing. Rows with the same id count as one document that every link of any of
    them reaches (ids are taken to be below 2**62). A row with a null id is never linked: its
    component_id is null and it is kept. An empty table gives an empty result.
    """
    p = params
    ws = Workspace(docs.sparkSession, "near")
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            tokens = [words(t) for t in batch.column(1).to_pylist()]
            sets = [shingle_set(t, p.shingle) for t in tokens]
            sig = signatures(sets, p.hashes)
            columns = [batch.column(0), pa.array([_copy_of(t) for t in tokens], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "copy", "size", "sig"])

    signed = ws.table(base.mapInArrow(sign, "id long, copy binary, size long, sig binary"), "signatures")
    usable = signed.where("id is not null and size > 0")
    # A node stands for all exact copies of a text. It is numbered like the smallest id that has the text;
    # where that id has several texts, all but one of them get a number from a hash above all ids.
    firsts = ws.table(usable.groupBy("copy").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies")
    shared = firsts.groupBy("rep").agg(F.min(F.xxhash64("copy")).alias("low"), F.max(F.xxhash64("copy")).alias("high")).where("low < high")
    h = F.xxhash64("copy")
    node = F.when(F.col("low").isNull() | (h == F.col("low")), F.col("rep")).otherwise(F.shiftrightunsigned(h, 2).bitwiseOR(F.lit(1 << 62)))
    firsts = ws.table(firsts.join(shared, "rep", "left").select("copy", "rep", node.alias("node"), "n"), "nodes")
    # Texts with over a thousandth of all rows are at most 1000; their copies are told by a broadcast, so no task gets a whole family.
    many = F.col("n") > max(signed.count() // 1000, 1)
    large = F.broadcast(firsts.where(many).select("copy", "node"))
    placed = usable.select("id", "copy").join(large, "copy", "left")
    rest = placed.where("node is null").select("id", "copy").join(firsts.where(~many).select("copy", "node"), "copy")
    members = ws.table(placed.where("node is not null").select("id", "node").union(rest.select("id", "node")).distinct(), "members")
    several = members.groupBy("id").agg(F.min("node").alias("src"), F.max("node").alias("high")).where("src < high")
    ties = members.join(several.select("id", "src"), "id").where("node <> src").select("src", F.col("node").alias("dst"))
    first_rows = firsts.select("copy", F.col("rep").alias("id"), "node")
    nodes = usable.join(first_rows, ["copy", "id"]).select(F.col("node").alias("id"), "size", "sig")

    def payloads(candidates: DataFrame) -> DataFrame:
        """Sets of the candidates' texts; texts of other ids are dropped where they are read."""
        wanted = first_rows.join(candidates.withColumnRenamed("id", "node"), "node", "left_semi")
        wanted = ws.table(wanted.withColumn("h", F.xxhash64("id")), "wanted")
        known = Bitmap(wanted, "h")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 256):
                few = batch.filter(pa.array(known.passes(batch.column("h").to_numpy())))
                tokens = [words(t) for t in few.column("text").to_pylist()]
                data = [shingle_set(t, p.shingle).tobytes() for t in tokens]
                yield pa.RecordBatch.from_arrays(
                    [few.column("id"), pa.array([_copy_of(t) for t in tokens], pa.binary()), pa.array(data, pa.binary())], names=["id", "copy", "payload"]
                )

        found = base.where("id is not null").select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(read, "id long, copy binary, payload binary")
        return found.join(wanted.select("id", "copy", "node"), ["id", "copy"]).select(F.col("node").alias("id"), "payload").dropDuplicates(["id"])

    components = similar_components(ws, p, nodes, payloads, lambda data: [np.frombuffer(d, dtype=np.uint64) for d in data], ties=ties)
    known = members.join(components, "node", "left").groupBy("id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    out = signed.select("id", "size").join(known, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )
