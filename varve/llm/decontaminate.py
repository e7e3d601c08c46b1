"""Benchmark decontamination on question templates.

Words become template tokens: numbers, names and units turn into typed placeholders, all else is
lower-cased. Windows of template tokens of documents and benchmark items meet in a hash join, so a
question with other numbers or names still matches. A match counts only where the slots agree: one
benchmark value stands for one document value throughout an alignment. Windows of the item's own
words always count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.batches import slices
from varve.llm.line_dedup import _rolling
from varve.operators.staging import Workspace

LITERAL, NUMBER, UNIT, NAME = 0, 1, 2, 3
# Unit words that become a placeholder after a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds "
    "oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years kmh mph hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa bar c f k degrees degree percent % "
    "dollar dollars cent cents euro euros usd eur gbp $ € £".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:st|nd|rd|th|%)?")
_MEASURE = re.compile(r"([+-]?\d[\d.,]*)([^\W\d]+)")
_EDGE = re.compile(r"^[^\w$€£+%-]+|[^\w%$€£]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PLACEHOLDERS = np.array([0, 0xA5A5A5A5A5A5A501, 0xA5A5A5A5A5A5A502, 0xA5A5A5A5A5A5A503], dtype=np.uint64)


@dataclass(frozen=True)
class Templates:
    """``window`` tokens make a window, which needs ``least_literals`` words that are no placeholders.

    A document is contaminated by an item when consistent windows cover ``least_covered`` of its
    tokens (all of them for shorter items). Items shorter than a window form one window of their own length.
    """

    window: int = 8
    least_literals: int = 4
    least_covered: int = 13
    #: Up to so many distinct benchmark windows (8 bytes each) are sent to the scan as a filter.
    max_filter_windows: int = 1_000_000


class Tokens(NamedTuple):
    """Of each token of a text: template hash, kind, place in the vocabulary, hash of the lower-cased word,
    and its kind as the first word of a window, which must not depend on what precedes: NUMBER, or LITERAL and
    besides the placeholder NAME (capital) or UNIT."""

    hashes: np.ndarray
    kinds: np.ndarray
    at: np.ndarray
    words: np.ndarray
    heads: np.ndarray


class Vocabulary:
    """Attributes of the words a worker has met: literal hash, kind, capital, sentence end. Emptied when large."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.core: list[str] = []
        self.literal, self.kind, self.capital, self.ends = (np.zeros(1024, dtype=t) for t in (np.uint64, np.int8, bool, bool))

    def add(self, word: str) -> None:
        core = _EDGE.sub("", word)
        low = core.lower()
        kind = -1 if not core else NUMBER if _NUMBER.fullmatch(core) else LITERAL
        if kind == LITERAL and (m := _MEASURE.fullmatch(low)) and m[2] in UNITS:
            kind = NUMBER
        if kind == LITERAL and low in UNITS:
            kind = UNIT
        n = len(self.core)
        if n == len(self.kind):
            self.literal, self.kind, self.capital, self.ends = (
                np.concatenate([x, np.zeros_like(x)]) for x in (self.literal, self.kind, self.capital, self.ends)
            )
        self.literal[n] = xxhash.xxh3_64_intdigest(low)
        self.kind[n] = kind
        self.capital[n] = kind == LITERAL and len(core) > 1 and core[0].isupper() and core[1:].islower()
        self.ends[n] = word.rstrip("\"'»”’)]}")[-1:] in (".", "!", "?", ":")
        self.core.append(low)
        self.place[word] = n

    def tokens(self, texts: list[str | None]) -> list[Tokens]:
        if len(self.place) > self.limit:
            self.clear()
        split = [(t or "").split() for t in texts]
        for words in split:
            for word in set(words):
                if word not in self.place:
                    self.add(word)
        literal, kind, capital, ends = self.literal, self.kind, self.capital, self.ends
        out = []
        for words in split:
            at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
            at = at[kind[at] >= 0]
            k = kind[at].copy()
            if len(at):
                begins = np.concatenate([[True], ends[at[:-1]]])
                after_number = np.concatenate([[False], k[:-1] == NUMBER])
                k[(k == UNIT) & ~after_number] = LITERAL
                k[capital[at] & ~begins & (k == LITERAL)] = NAME
            out.append(Tokens(np.where(k == LITERAL, literal[at], _PLACEHOLDERS[k]), k, at, literal[at], np.where(capital[at], np.int8(NAME), kind[at])))
        return out


def windows(t: Tokens, width: int, least_literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and hash of every window with enough literals, and whether its first word is a slot.

    A window that begins with a name or unit comes twice, with that word as a literal and as a placeholder.
    """
    n = len(t.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=bool)
    rest = np.full(n, width, dtype=np.uint64)
    for j in range(1, width):
        rest = ((rest ^ (rest >> np.uint64(29))) * _MIX) ^ t.hashes[j : n + j]
    rest = (rest ^ (rest >> np.uint64(29))) * _MIX
    heads, least = t.heads[:n], min(least_literals, width)
    literals = np.concatenate([[0], np.cumsum(t.kinds == LITERAL)])
    literals = literals[width:] - literals[1 : n + 1]
    number = heads == NUMBER
    plain = np.flatnonzero(literals + ~number >= least)
    other = np.flatnonzero((literals >= least) & ~number & (heads != LITERAL))
    h = np.concatenate([rest[plain] ^ np.where(number, _PLACEHOLDERS[NUMBER], t.words[:n])[plain], rest[other] ^ _PLACEHOLDERS[heads[other]]])
    slot = np.concatenate([number[plain], np.ones(len(other), dtype=bool)])
    return np.concatenate([plain, other]), (h ^ (h >> np.uint64(32))) * _MIX, slot


def word_windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of lower-cased words, whatever their kinds."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    return _rolling(words, width) ^ np.uint64(width)


def _slots(t: Tokens, core: list[str], start: int, width: int, head: bool) -> list[str]:
    return [core[t.at[i]] for i in range(start, start + width) if (head if i == start else t.kinds[i] != LITERAL)]


def benchmark_windows(items: DataFrame, p: Templates, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(hash, item, item_at, width, item_tokens, item_slots, exact)`` and the ``(item, exact, member)`` it stands for.

    Of items whose templates are equal and whose slots repeat at the same places the smallest id stands for all.
    Exact windows are those of words; every item has its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        for batch in slices(batches, 256):
            rows = []
            found = vocabulary.tokens(batch.column(1).to_pylist())
            for item, t in zip(batch.column(0).to_pylist(), found, strict=True):
                if n := len(t.hashes):
                    width = min(p.window, n)
                    first: dict[str, int] = {}
                    pattern = [first.setdefault(v, i) for i, v in enumerate(vocabulary.core[j] for j in t.at[(t.kinds != LITERAL) | (t.heads != LITERAL)])]
                    # Windows that begin with a name or unit hold its word, so these words belong to the template.
                    begins = np.where(t.heads == NUMBER, _PLACEHOLDERS[NUMBER], t.words)
                    template = xxhash.xxh3_64_intdigest(t.hashes.tobytes() + begins.tobytes() + np.array(pattern, dtype=np.int64).tobytes()) - (1 << 63)
                    for start, h, head in zip(*windows(t, width, p.least_literals), strict=True):
                        rows.append((int(h.view(np.int64)), item, int(start), width, n, _slots(t, vocabulary.core, start, width, head), False, template))
                    for start, h in enumerate(word_windows(t.words, width)):
                        rows.append((int(h.view(np.int64)), item, start, width, n, [], True, template))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds_)], names=names)

    names = ["hash", "item", "item_at", "width", "item_tokens", "item_slots", "exact", "template"]
    kinds_ = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.bool_(), pa.int64()]
    schema = "hash long, item long, item_at int, width int, item_tokens int, item_slots array<string>, exact boolean, template long"
    rows = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null").mapInArrow(cut, schema)
    firsts = rows.groupBy("template").agg(F.min("item").alias("item"))
    every = rows.select("template", F.col("item").alias("member")).distinct()
    members = every.join(firsts, "template").select("item", F.lit(False).alias("exact"), "member")
    members = members.union(every.select(F.col("member").alias("item"), F.lit(True), "member")).distinct()
    kept = rows.where("not exact").join(firsts, ["template", "item"], "left_semi").select(*rows.columns).union(rows.where("exact"))
    return kept.drop("template").dropDuplicates(["item", "item_at", "hash"]), members


def contamination(
    docs: DataFrame, items: DataFrame, params: Templates = Templates(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``(doc_id, item_id, covered, item_tokens)``: pairs of a document and a benchmark item it contains.

    ``covered`` counts the item's tokens under windows of consistent alignments and under windows of
    its own words, which count even where the rest of the alignment disagrees. Null texts and
    texts without words match nothing; rows with the same id count as one document, and so do rows
    with a null id. A text that repeats an item gives one row. Every item of a family with the same
    template and the same repeats of slots is reported.
    """
    p = params
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    bench, members = benchmark_windows(items, p, item_id, item_text)
    bench, members = ws.table(bench, "benchmark"), ws.table(members, "members")
    widths = [r[0] for r in bench.select("width").distinct().collect()]  # at most ``window`` different numbers
    known = None
    if bench.count() <= p.max_filter_windows:
        known = spark.sparkContext.broadcast(np.unique(np.array([r[0] for r in bench.select("hash").collect()], dtype=np.int64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary()
        wanted = known.value if known is not None else None
        if wanted is not None:
            # A bitmap of 20 bits of the hash settles nearly all windows without a search.
            bitmap = np.zeros(1 << 20, dtype=bool)
            bitmap[wanted.view(np.uint64) >> np.uint64(44)] = True

        def known_only(h: np.ndarray) -> np.ndarray:
            if wanted is None or not len(h):
                return np.arange(len(h))
            hit = np.flatnonzero(bitmap[h >> np.uint64(44)])
            value = h[hit].view(np.int64)
            return hit[wanted[np.minimum(np.searchsorted(wanted, value), len(wanted) - 1)] == value]

        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [])
            found = vocabulary.tokens(batch.column(1).to_pylist())
            for doc, t in zip(batch.column(0).to_pylist(), found, strict=True):
                for width in widths:
                    starts, h, heads = windows(t, width, p.least_literals)
                    hit = known_only(h)
                    starts, h, heads = starts[hit], h[hit], heads[hit]
                    out[3].extend(_slots(t, vocabulary.core, s, width, head) for s, head in zip(starts, heads, strict=True))
                    exact = word_windows(t.words, width)
                    exact_starts = known_only(exact)
                    exact = exact[exact_starts]
                    out[3].extend([] for _ in exact_starts)
                    out[0].extend([doc] * (len(h) + len(exact)))
                    out[1].extend(np.concatenate([h, exact]).view(np.int64).tolist())
                    out[2].extend(np.concatenate([starts, exact_starts]).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)],
                names=["doc", "hash", "at", "slots"],
            )

    found = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(scan, "doc long, hash long, at int, slots array<string>")
    hits = found.join(bench, "hash").withColumn("shift", F.col("at") - F.col("item_at"))
    pairs = F.arrays_zip("item_slots", "slots")
    # One alignment holds each window of the item once, so what is collected is bounded by the item.
    aligned = hits.groupBy("doc", "item", "shift", "exact").agg(
        F.collect_set(F.struct("item_at", "width")).alias("places"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"),
        F.max("item_tokens").alias("item_tokens"),
    )
    one_to_one = F.size(F.array_distinct(F.transform("pairs", lambda x: x["item_slots"]))) == F.size("pairs")
    tokens = F.transform("places", lambda w: F.sequence(w["item_at"], w["item_at"] + w["width"] - 1))
    aligned = aligned.where(one_to_one).select("doc", "item", "exact", "item_tokens", F.array_distinct(F.flatten(tokens)).alias("tokens"))
    aligned = aligned.join(members, ["item", "exact"]).select("doc", F.col("member").alias("item"), "item_tokens", F.explode("tokens").alias("token"))
    covered = aligned.groupBy("doc", "item").agg(F.max("item_tokens").alias("item_tokens"), F.countDistinct("token").alias("covered"))
    covered = covered.where(F.col("covered") >= F.least(F.lit(p.least_covered), F.col("item_tokens")))
    return covered.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "covered", F.col("item_tokens").cast("long").alias("item_tokens"))


def judge(docs: DataFrame, pairs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Add ``n_items``, ``item_id`` (the smallest), ``contaminated`` and ``kept`` to every row of ``docs``."""
    added = ["n_items", "item_id", "contaminated", "kept"]
    found = pairs.groupBy(F.col("doc_id").alias("d_")).agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("item_id"))
    out = docs.select([c for c in docs.columns if c not in added]).join(found, F.col(doc_id).eqNullSafe(F.col("d_")), "left").drop("d_")
    hit = F.col("item_id").isNotNull()
    return out.withColumns({"n_items": F.coalesce("n_items", F.lit(0)), "contaminated": hit, "kept": ~hit})
