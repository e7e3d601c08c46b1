"""Byte-level BPE encoding and decoding.

The merge loop keeps a segment tree over the byte positions of one piece. A leaf holds the rank of
the pair that starts at its position; an inner node holds the leftmost position of the smallest
rank below it. A merge updates the leaves of the merged token, of its removed right half and of
its live left neighbour, each in logarithmic time, so a piece of n bytes takes O(n log n).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NO_RANK = 1 << 62
#: Pieces whose ids a worker remembers in each of two generations; rare pieces are merged anew.
CACHE_PIECES = 300_000
#: Longer pieces are not remembered.
CACHE_BYTES = 64


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: repeatedly merge the leftmost adjacent pair of smallest rank.

    >>> merge(b"aaa", {b"a": 0, b"aa": 1})
    [1, 0]
    """
    n = len(piece)
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if n < 2:
        return [ranks[piece]] if n else []
    width = 1 << (n - 1).bit_length()
    ends = list(range(1, n + 1))  # end of the live token that starts at a position
    before = list(range(-1, n - 1))  # start of the live token to the left
    # leaf value of a position: rank * width + position, so the minimum is the leftmost smallest rank
    empty = NO_RANK
    tree = [empty] * (2 * width)
    for at in range(n - 1):
        rank = ranks.get(piece[at : at + 2])
        if rank is not None:
            tree[width + at] = rank * width + at
    for node in range(width - 1, 0, -1):
        left, right = tree[2 * node], tree[2 * node + 1]
        tree[node] = left if left < right else right

    def update(at: int, value: int) -> None:
        node = width + at
        tree[node] = value
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left < right else right
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1

    while tree[1] != empty:
        at = tree[1] % width
        gone = ends[at]
        end = ends[gone]
        ends[at] = end
        if tree[width + gone] != empty:
            update(gone, empty)
        if end < n:
            before[end] = at
            rank = ranks.get(piece[at : ends[end]])
            update(at, empty if rank is None else rank * width + at)
        else:
            update(at, empty)
        left = before[at]
        if left >= 0:
            rank = ranks.get(piece[left:end])
            update(left, empty if rank is None else rank * width + left)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return ids


@dataclass(frozen=True)
class ByteBpe:
    """A rank file (base64 token and rank per line) and the pattern that splits text into pieces."""

    rank_file: str
    pattern: str

    @property
    def tables(self) -> tuple[dict[bytes, int], dict[int, bytes], regex.Pattern]:
        return _load(self.rank_file, self.pattern)

    def encode(self, text: str) -> list[int]:
        ranks, _, pattern = self.tables
        return [i for piece in pattern.findall(text) for i in merge(piece.encode(), ranks)]

    def decode(self, ids: list[int]) -> bytes:
        _, tokens, _ = self.tables
        return b"".join(tokens[i] for i in ids)

    def token_ids(self, text: Column) -> Column:
        """Ids of a whole text as an array; a null text has none."""
        this = self

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in texts:
                yield pd.Series([this.encode(t or "") for t in series])

        return apply(text)

    def digest(self, text: Column) -> Column:
        """A struct (n_tokens, ids_sha256, decoded_sha256) of a whole text, without sending its ids back.

        ids_sha256 is over the decimal ids joined by one space, decoded_sha256 over the bytes that
        the ids decode to. A null text counts as empty.
        """
        this = self
        result = T.StructType(
            [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        )

        @F.pandas_udf(result)
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            ranks, tokens, pattern = this.tables
            generations = _remembered(this.rank_file)
            older, recent = generations
            for series in texts:
                rows = []
                for text in series:
                    count, written, decoded = 0, [], []
                    for piece in pattern.findall(text or ""):
                        found = recent.get(piece)
                        if found is None:
                            found = older.get(piece)
                            if found is not None:
                                recent[piece] = found
                        if found is None:
                            data = piece.encode()
                            ids = merge(data, ranks)
                            found = (len(ids), " ".join(map(str, ids)), b"".join(tokens[i] for i in ids))
                            if len(data) <= CACHE_BYTES:
                                if len(recent) >= CACHE_PIECES:
                                    older, recent = recent, {}
                                    generations[:] = [older, recent]
                                recent[piece] = found
                        count += found[0]
                        written.append(found[1])
                        decoded.append(found[2])
                    rows.append((count, hashlib.sha256(" ".join(written).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return apply(text)


@lru_cache(maxsize=2)
def _load(rank_file: str, pattern: str) -> tuple[dict[bytes, int], dict[int, bytes], regex.Pattern]:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return ranks, {rank: token for token, rank in ranks.items()}, regex.compile(pattern)


@lru_cache(maxsize=2)
def _remembered(rank_file: str) -> list[dict[str, tuple[int, str, bytes]]]:
    """The older and the recent generation of known pieces, kept by a worker between its tasks."""
    return [{}, {}]
