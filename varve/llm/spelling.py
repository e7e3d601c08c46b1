"""Spelling variants: words that differ by one edit, found in a forward and a reversed sorted dictionary.

One inserted, deleted or replaced code point leaves one half of a word intact. So two near words share either their
first half, and lie in one range of the sorted dictionary, or their second half, and lie in one range of the
dictionary sorted by reversed words. A range that holds too many words is subdivided: what its words do not share yet
has two halves as well, of which again one is intact. Every pair is kept by exactly one range, so nothing is joined twice.

The length in the key of a range is that of the shorter word; a word lies in the ranges of its own length and, as the
longer one, of one less.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from varve.operators.staging import Workspace



@dataclass(frozen=True)
class Spelling:
    """Parameters: words of at least ``min_length`` code points seen ``min_count`` times; a form is ``ratio`` times as frequent.

    A range of more than ``block`` words is subdivided as long as its words differ in two or more places.
    """

    min_length: int = 7
    min_count: int = 2
    ratio: int = 10
    block: int = 192


def runs(text: Column) -> Column:
    """All runs of letters of a text with A-Z in lower case; a null text has none."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(F.coalesce(lowered, F.lit("")), F.lit("[a-z\\u00C0-\\u00FF]+"), F.lit(0))


def with_slips(doc_id: Column, run: Column, one_in: int = 31) -> Column:
    """``run`` without one code point where ``one_in`` divides the CRC-32 h of ``<doc_id>:<run>``: that at h modulo its length.

    A null id has no checksum, so its runs stay.
    """
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % one_in == 0, cut).otherwise(run)


def vocabulary(occurrences: DataFrame, p: Spelling) -> DataFrame:
    """``(word, n)`` of the words of ``occurrences`` that are long and frequent enough; counted in part before the shuffle."""
    long_enough = occurrences.where(F.char_length("word") >= p.min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.min_count)


def _ranges(words: DataFrame) -> DataFrame:
    """Every word in its four ranges: ``(word, n, length, head, tail)``; ``length`` of the shorter word, ``head`` and ``tail`` shared code points."""
    size = F.char_length("word")
    lengths = F.explode(F.array(size, size - 1)).alias("length")
    half = F.floor(F.col("length") / 2).cast("int")
    ends = F.explode(F.array(F.struct(half.alias("head"), F.lit(0).alias("tail")), F.struct(F.lit(0).alias("head"), (F.col("length") - half).cast("int").alias("tail")))).alias("end")
    return words.select("word", "n", lengths).select("word", "n", "length", ends).select("word", "n", "length", "end.*")


def _key(rows: DataFrame) -> DataFrame:
    """With ``key``: equal for the words of one range, and sorted as the forward or the reversed dictionary is."""
    word = F.col("word")
    shared = F.concat_ws(" ", F.substring(word, F.lit(1), F.col("head")), F.reverse(F.substring(word, F.char_length(word) - F.col("tail") + 1, F.col("tail"))))
    return rows.withColumn("key", F.concat_ws("/", F.when(F.col("tail") == 0, "f").otherwise("r"), F.col("length").cast("string"), F.col("head").cast("string"), F.col("tail").cast("string"), shared))


def _halved(rows: DataFrame) -> DataFrame:
    """The two narrower ranges of every word: the first or the second half of what is not shared yet is shared too."""
    open_ = F.col("length") - F.col("head") - F.col("tail")
    half = F.floor(open_ / 2).cast("int")
    ends = F.explode(
        F.array(
            F.struct((F.col("head") + half).cast("int").alias("head"), F.col("tail").alias("tail")),
            F.struct(F.col("head").alias("head"), (F.col("tail") + open_ - half).cast("int").alias("tail")),
        )
    ).alias("end")
    return rows.select("word", "n", "length", ends).select("word", "n", "length", "end.*")


def ranges(words: DataFrame, p: Spelling, ws: Workspace) -> DataFrame:
    """``(word, n, length, head, tail, key)`` of all ranges with at least two words, the large ones subdivided.

    Each round counts the words of every range (in part before the shuffle) and halves those that are too large; a range
    whose words differ in one place at most holds only true neighbours and stays, whatever its size.
    """
    current = ws.table(_key(_ranges(words)), "ranges")
    settled = []
    while True:
        sizes = ws.table(current.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.any_value(F.col("length") - F.col("head") - F.col("tail")).alias("open")).where("size > 1"), "sizes")
        large = (F.col("size") > p.block) & (F.col("open") > 1)
        settled.append(current.join(sizes.where(~large).select("key"), "key", "left_semi"))
        watch = Observation()
        rest = ws.table(_key(_halved(current.join(sizes.where(large).select("key"), "key", "left_semi"))).observe(watch, F.count(F.lit(1)).alias("n")), "rest")
        if not watch.get["n"]:
            break
        current = rest
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def _codes(words: list[str], width: int) -> np.ndarray:
    """Code points of words as rows of one matrix, 0 where a word is shorter."""
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width)


def near_pairs(words: list[str], length: int, bound: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of distinct words that are one edit apart, the first of ``length`` code points, the second of as many or one more.

    With a ``bound``, only pairs whose first difference lies before it.
    """
    sizes = np.array([len(w) for w in words])
    short, longer = np.flatnonzero(sizes == length), np.flatnonzero(sizes == length + 1)
    codes = _codes(words, length + 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max((1 << 21) // max(len(words) * (length + 1), 1), 1)  # bounds the comparison matrix
    for start in range(0, len(short), step):
        rows = short[start : start + step]
        a = codes[rows][:, None, :length]
        same = a == codes[short][None, :, :length]
        differ = (~same).sum(2)
        i, j = np.nonzero((differ == 1) & (rows[:, None] < short[None, :]))
        first = np.argmin(same[i, j], axis=1) if len(i) else i
        keep = slice(None) if bound is None else first < bound
        found.append((rows[i][keep], short[j][keep]))
        if len(longer):
            b = codes[longer][None, :, :]
            ahead = (a == b[:, :, :length]).cumprod(2, dtype=np.uint8).sum(2, dtype=np.int64)  # shared code points from the left
            behind = (a == b[:, :, 1:])[:, :, ::-1].cumprod(2, dtype=np.uint8).sum(2, dtype=np.int64)  # and from the right
            i, j = np.nonzero(ahead + behind >= length)
            keep = slice(None) if bound is None else ahead[i, j] < bound
            found.append((rows[i][keep], longer[j][keep]))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, list[str], list[int]]]:
    """Ranges of a sorted partition: key, length, tail, words and counts; one range is held at a time."""
    key, words, counts, length, tail = None, [], [], 0, 0
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("key", "length", "tail", "word", "n")]
        for k, size, t, w, n in zip(*columns):
            if k != key:
                if len(words) > 1:
                    yield key, length, tail, words, counts
                key, words, counts, length, tail = k, [], [], size, t
            words.append(w)
            counts.append(n)
    if len(words) > 1:
        yield key, length, tail, words, counts


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both directions of the near pairs of a sorted partition's ranges."""
    for _, length, tail, words, counts in _blocks(batches):
        # In a range that shares an end, a pair belongs here only if its first difference precedes that end: others share the first half.
        a, b = near_pairs(words, length, length - tail if tail else None)
        if len(a):
            word, n = np.array(words, dtype=object), np.array(counts)
            left, right = np.concatenate([a, b]), np.concatenate([b, a])
            yield pa.RecordBatch.from_arrays([pa.array(word[left], pa.string()), pa.array(word[right], pa.string()), pa.array(n[right], pa.int64())], ["word", "near", "near_n"])


def neighbours(words: DataFrame, p: Spelling = Spelling(), ws: Workspace | None = None) -> DataFrame:
    """``(word, near, near_n)``: every ordered pair of distinct words one edit apart; ``words`` is a stored ``(word, n)``."""
    ws = ws or Workspace(words.sparkSession, "spelling")
    spread = ws.table(ranges(words, p, ws), "spread")
    dictionary = spread.repartitionByRange("key").sortWithinPartitions("key", "word")
    return dictionary.select("key", "length", "tail", "word", "n").mapInArrow(_neighbours, "word string, near string, near_n long")


def variants(words: DataFrame, p: Spelling = Spelling()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``(word, n)``.

    ``form`` is the near word of largest n (ties: the smallest), null unless that n is ``ratio`` times the word's; ``root``
    is the last of the forms that follow each other from the word, itself if it has none. An empty table gives no rows.
    """
    ws = Workspace(words.sparkSession, "spelling")
    words = ws.table(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near")))
    near = neighbours(words, p, ws).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(near, "word", "left")
    frequent = -F.col("best.m") >= p.ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")
    )
    rows = ws.table(rows, "rows")
    roots = ws.table(rows.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # pointers double their reach; n grows along a chain by the ratio, so it is short
        watch = Observation()
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        stepped = roots.join(onward, "root", "left").observe(watch, F.count("onward").alias("moved"))
        roots = ws.table(stepped.select("word", F.coalesce("onward", "root").alias("root")), "roots")
        if not watch.get["moved"]:
            break
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_words(docs: DataFrame) -> DataFrame:
    """``(word)``: every run of letters of every whole text, with the slips that the checksum of id and run asks for."""
    run = docs.select("doc_id", F.explode(runs(F.col("text"))).alias("run"))
    return run.select(with_slips(F.col("doc_id"), F.col("run")).alias("word"))
