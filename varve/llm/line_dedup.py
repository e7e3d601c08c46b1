"""Fuzzy line deduplication by MinHash over character shingles.

Equal lines collapse by hash. Distinct lines are signed on character shingles, meet in high-recall
bands, are verified by exact Jaccard similarity and joined by distributed union-find; the first
line of each component stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.batches import sized_slices
from varve.llm.membership import Bitmap
from varve.llm.minhash import BLOCK_SCHEMA, Banding, flat_signatures, node_block, similar_components
from varve.operators.staging import Workspace

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LineDedup(Banding):
    """12 bands of 4 hashes miss a pair at exactly 80 % similarity with probability 2e-3, at 90 % with 3e-6.

    Bands of 3 would need fewer of them, but lines that share a few words by chance meet in them, and
    such meetings grow with the square of the number of lines.

    ``shingle`` is in characters; lines shorter than ``min_chars`` are compared with no other line.
    With ``exact_all`` equal lines are linked at any length, if they hold more than white space;
    without it lines shorter than ``min_chars`` are always kept. ``steps`` give lines of different
    lengths different shingles, each step as (shingle, fewest, most characters of a line); two lines
    are compared in every step that holds both. Without steps all lines have the same shingle.
    """

    bands: int = 12
    rows: int = 4
    batch: int = 12
    shingle: int = 9
    min_chars: int = 25
    tile_shingles: int = 200_000
    exact_all: bool = False
    sized: bool = False
    steps: tuple[tuple[int, int, int], ...] = ()

    @property
    def ladder(self) -> tuple[tuple[int, int, int], ...]:
        return self.steps or ((self.shingle, self.min_chars, 2**31 - 1),)


#: What the query and the pipeline use. A changed character inside a line alters as many shingles as
#: they have characters, so 3 reach 80 % from 29 characters on, 5 from 49 and 9 from 89; a changed word
#: of six letters reaches it under 9 from 134. Lines of two steps whose lengths are too far apart to
#: share one are below 80 % unless shingles repeat.
WHOLE = LineDedup(exact_all=True, steps=((3, 25, 64), (5, 49, 180), (9, 140, 2**31 - 1)))


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k codes, as wide as the codes; windows are put together from windows of powers of two."""
    kind = codes.dtype.type
    mix, half = kind(0x9E3779B97F4A7C15 >> (64 - 8 * codes.itemsize) | 1), 4 * codes.itemsize
    power = codes * mix
    power ^= power >> kind(half - 1)
    out, width, span = None, 0, 1
    while True:
        if k & span:
            if out is None:
                out, width = power, span
            else:
                n = len(codes) - width - span + 1
                out = (out[:n] * mix) ^ power[width : width + n]
                width += span
        if width == k:
            break
        power = (power[: len(power) - span] * mix) ^ power[span:]
        power ^= power >> kind(half - 3)
        span *= 2
    out = (out ^ (out >> kind(half))) * mix
    return out ^ (out >> kind(half - 3))


def shingle_hashes(lines: list[str], k: int, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-character shingles of all lines one after another, repeats included, and their number per line.

    A line of fewer characters is padded to one shingle, an empty line has none.
    """
    padded = [line if len(line) >= k or not line else line + "\0" * (k - len(line)) for line in lines]
    lengths = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    counts = np.maximum(lengths - k + 1, 0)
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(kind, copy=False)
    if not counts.any():
        return np.zeros(0, dtype=kind), counts
    inside = np.ones(len(codes), dtype=bool)
    for back in range(1, k):  # windows that start in the last k - 1 characters of a line leave it
        inside[np.cumsum(lengths)[lengths >= k] - back] = False
    return _rolling(codes, k)[inside[: len(codes) - k + 1]], counts


def shingle_sets(lines: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-character shingles of each line."""
    hashes, counts = shingle_hashes(lines, k)
    ends = np.cumsum(counts)
    out = []
    for begin, end in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        one = np.sort(hashes[begin:end])
        out.append(one[np.concatenate([[True], one[1:] != one[:-1]])] if len(one) else one)
    return out


def find_duplicates(docs: DataFrame, params: LineDedup = LineDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no)`` of every line to drop: the places of :func:`mark_duplicates`."""
    return mark_duplicates(docs, params, doc_id, text).select("doc_id", "line_no").distinct()


def mark_duplicates(docs: DataFrame, params: LineDedup = LineDedup(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, line_no, check)`` of every line to drop; the smallest (doc_id, line_no) of each component is not among them.

    Lines are what ``\\n`` separates, numbered from 0. Lines of at least ``min_chars`` characters
    are linked when equal or when their character shingles reach the threshold, other lines that are
    not blank when equal and ``exact_all`` is set. Null texts have no
    lines. Rows with a null id take part with no lines. ``check`` is Spark's xxhash64 of the line: of
    rows with the same id only those lose a line that hold it at this number; a line that several of
    them hold there comes several times. An empty table gives none.
    """
    p = params
    ws = Workspace(docs.sparkSession, "lines")
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")

    def lines_of(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The lines that take part, the row of each and its number there."""
        split = pc.split_pattern(batch.column("text"), "\n")
        lines, rows, offsets = split.flatten(), pc.list_parent_indices(split).to_numpy(), split.offsets.to_numpy()
        numbers = np.arange(len(lines)) - (offsets - offsets[0])[rows]
        if p.exact_all:
            wanted = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0)
        else:
            wanted = pc.greater_equal(pc.utf8_length(lines), p.min_chars)
        chosen = wanted.to_numpy(zero_copy_only=False)
        return lines.filter(wanted), rows[chosen], numbers[chosen]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with ``doc`` for every line, and blocks with a node for each way in which a line is compared."""
        recent: set[int] = set()  # lines this task has signed; others may sign them again
        for batch in sized_slices(batches, 1024, 1 << 22):
            lines, rows, numbers = lines_of(batch)
            ids, checks = _hashes(lines)
            places = [pa.array(ids), pa.array(checks), batch.column("doc").take(pa.array(rows)), pa.array(numbers, pa.int32())]
            yield _rows(places, [None] * 4, len(ids))
            if len(recent) > _REMEMBERED:
                recent.clear()
            seen, at = np.unique(ids, return_index=True)
            at = np.sort(at[[i not in recent for i in seen.tolist()]])
            recent.update(seen.tolist())
            lengths = pc.utf8_length(lines).to_numpy()
            for step, (k, least, most) in enumerate(p.ladder):
                fresh = at[(lengths[at] >= least) & (lengths[at] <= most)]
                for i in range(0, len(fresh), 1024):
                    some = fresh[i : i + 1024]
                    hashes, counts = shingle_hashes(lines.take(pa.array(some)).to_pylist(), k, np.uint32)
                    sig = flat_signatures(hashes, counts, p.hashes)
                    yield _rows([None] * 4, node_block(ids[some] | step, counts, sig), 1)

    signed = ws.table(base.mapInArrow(sign, f"line long, check long, doc long, line_no int, {BLOCK_SCHEMA}"), "signed")
    places = signed.where("doc is not null").select("line", "check", "doc", "line_no")
    nodes = signed.where("n is not null").select("n", "ids", "sizes", "sigs")

    def payloads(candidates: DataFrame) -> DataFrame:
        """The candidates' lines; other lines are dropped where they are read."""
        wanted = ws.table(candidates.select(F.col("id").bitwiseAND(F.lit(~_STEP)).alias("line")).distinct(), "wanted")
        known = Bitmap(wanted, "line")

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            recent: set[int] = set()
            for batch in sized_slices(batches, 1024, 1 << 22):
                lines = lines_of(batch)[0]
                ids = _ids(lines.cast(pa.binary()).to_pylist())
                ids, first = np.unique(ids, return_index=True)
                few = known.passes(ids)
                few[few] = [i not in recent for i in ids[few].tolist()]
                if len(recent) > _REMEMBERED:
                    recent.clear()
                recent.update(ids[few].tolist())
                data = lines.take(pa.array(first[few])).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[few]), data], names=["line", "data"])

        texts = base.mapInArrow(read, "line long, data binary").join(wanted, "line", "left_semi").dropDuplicates(["line"])
        step = F.col("id").bitwiseAND(F.lit(_STEP))
        named = candidates.select("id", F.col("id").bitwiseAND(F.lit(~_STEP)).alias("line"), step.alias("step")).join(texts, "line")
        return named.select("id", F.concat(F.encode(F.chr("step"), "utf-8"), "data").alias("payload"))

    def to_sets(data: list[bytes]) -> list[np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for step, (k, _, _) in enumerate(p.ladder):
            some = [i for i, d in enumerate(data) if d[0] == step]
            out |= zip(some, shingle_sets([data[i][1:].decode() for i in some], k), strict=True)
        return [out[i] for i in range(len(data))]

    linked = similar_components(ws, p, nodes, payloads, to_sets, lambda node: node.bitwiseAND(F.lit(~_STEP)))
    # Lines that are repeated or linked; equal lines have equal ``line`` and ``check``, 126 bits of hashes.
    counted = places.groupBy("line", "check").agg(F.count(F.lit(1)).alias("n"))
    grouped = counted.join(linked.withColumnRenamed("node", "line"), "line", "left").where("n > 1 or component is not null")
    grouped = grouped.select("line", "check", F.coalesce("component", "line").alias("component"), F.when(F.col("component").isNull(), F.col("check")).otherwise(F.lit(0)).alias("own"))
    held = ws.table(places.join(grouped, ["line", "check"]), "held")
    keep = held.groupBy("component", "own").agg(F.min(F.struct("doc", "line_no")).alias("keep"), F.count(F.lit(1)).alias("total")).where("total > 1")
    keep = ws.table(keep, "keep")
    # Components with over a thousandth of these places are at most 1000; their first places are told by a broadcast, so no task gets a whole one.
    many = F.col("total") > max(held.count() // 1000, 1)
    told = held.join(F.broadcast(keep.where(many)), ["component", "own"], "left")
    rest = told.where("keep is null").drop("keep", "total").join(keep.where(~many), ["component", "own"])
    dropped = told.where("keep is not null").unionByName(rest).where("doc <> keep.doc or line_no <> keep.line_no")
    return ws.table(dropped.select(F.col("doc").alias("doc_id"), "line_no", "check"), "dropped")


#: The low bits of a node's id, in which it differs from the id of its line: the place of its shingle length in the ladder.
_STEP = 3
#: Lines a task remembers having met.
_REMEMBERED = 100_000


def _hashes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every line: one with the low bits of ``_STEP`` clear, and Spark's ``xxhash64``."""
    data = lines.cast(pa.binary()).to_pylist()
    checks = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=42), data), dtype=np.uint64, count=len(data))
    return _ids(data), checks.view(np.int64)


def _ids(data: list[bytes]) -> np.ndarray:
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, data), dtype=np.uint64, count=len(data))
    return (ids & np.uint64(~_STEP & (1 << 64) - 1)).view(np.int64)


def _rows(place: list, node: list, n: int) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    columns = [pa.nulls(n, t) if c is None else c for c, t in zip([*place, *node], kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["line", "check", "doc", "line_no", "n", "ids", "sizes", "sigs"])


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, marks: pd.Series) -> pd.Series:
    """Texts without the marked lines; a mark counts only where the line has its hash, or has none. Null marks leave a text as it is."""

    def clean(text: str | None, marked: list | None) -> str | None:
        if text is None or marked is None:
            return text
        known: dict[int, set] = {}
        for m in marked:
            known.setdefault(m["line_no"], set()).add(m["check"])
        goes = lambda n, line: n in known and (None in known[n] or _signed(xxhash.xxh64_intdigest(line.encode(), 42)) in known[n])
        return "\n".join(line for n, line in enumerate(text.split("\n")) if not goes(n, line))

    return pd.Series([clean(t, m) for t, m in zip(texts, marks, strict=True)], dtype=object)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Told to be nondeterministic so that a filter on the cleaned text does not run it a second time, in a second Python worker of the same task.
_without = _without.asNondeterministic()


def drop_lines(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the dropped lines, same columns; texts without dropped lines come back unchanged.

    A line goes where its number and, given a column ``check``, its content were marked: of rows with
    the same id each then loses only lines of its own.
    """
    if "check" not in dropped.columns:
        dropped = dropped.withColumn("check", F.lit(None).cast("long"))
    marks = dropped.groupBy(F.col("doc_id").alias("d_")).agg(F.collect_set(F.struct("line_no", "check")).alias("marks_"))
    joined = docs.join(marks, F.col(doc_id) == F.col("d_"), "left")
    cleaned = F.when(F.col("marks_").isNull(), F.col(text)).otherwise(_without(F.when(F.col("marks_").isNotNull(), F.col(text)), "marks_"))
    return joined.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns])


def summary(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_lines, n_dropped, dropped_lines, kept)`` for every row; kept is false where nothing but dropped lines was there.

    Rows with the same id share their list of dropped lines; repeated rows of ``dropped`` count once. Null texts have no lines.
    """
    numbers = dropped.groupBy(F.col("doc_id").alias("d_")).agg(F.array_sort(F.collect_set("line_no")).alias("dropped_lines"))
    n = F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1)
    counted = docs.select(F.col(doc_id).alias("doc_id"), n.cast("long").alias("n_lines"))
    out = counted.join(numbers, F.col("doc_id") == F.col("d_"), "left").drop("d_")
    out = out.withColumn("dropped_lines", F.coalesce("dropped_lines", F.array().cast("array<int>")))
    out = out.withColumn("n_dropped", F.size("dropped_lines").cast("long"))
    return out.withColumn("kept", (F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
