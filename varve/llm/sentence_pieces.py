"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat array. Every round looks up the rank of each adjacent pair, takes the
smallest rank of each word by a segmented minimum, merges that rank's leftmost non-overlapping pairs in all words at
once, and compacts the array; words without a mergeable pair leave it. Merging several pairs of a word at once equals
merging them one by one as long as no merge makes a pair of the same or a smaller rank; words where one would are
merged from the left up to the point where a smaller rank appears.

No merged piece holds a space mark after another character, nor one of some white-space characters, so text is cut
into words there and a word's ids can be remembered.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: U+2581, which stands for a space in pieces.
SPACE = "▁"
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NO_RANK = np.int64(1 << 40)
#: Words that a worker remembers in each of two generations, and the longest word that is remembered.
CACHE_WORDS, CACHE_CHARS = 300_000, 48
#: Symbols that one flat array holds; a longer word has an array of its own.
FLAT_SYMBOLS = 1 << 18


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol-buffer message; 32- and 64-bit values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """A BPE model file with byte fallback and an identity normalizer; other models are refused."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        pieces, kinds, scores, trainer, normalizer = [], [], [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append(f[1].decode())
                scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2 or trainer.get(24, 0) or not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE} or kinds.count(BYTE) != 256:
            raise ValueError("not a BPE model with byte fallback and without user-defined pieces")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only an identity normalizer with a prefixed space is supported")
        self.size, self.kinds = len(pieces), kinds
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        #: Bytes of every id; control and unknown ids decode to nothing and to U+2047 between spaces.
        self.bytes_of = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() for p, k in zip(pieces, kinds)]
        self.byte_ids = [0] * 256
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(pieces[i][3:5], 16)] = i
        # Symbols are piece ids; characters that only occur inside pieces follow them, and then all others.
        self.symbol = {p: i for p, i in normal.items()}
        for p in normal:
            for c in p:
                self.symbol.setdefault(c, self.size + len(self.symbol))
        #: Characters that are no piece by themselves but occur in one.
        self.inner = {s: c for c, s in self.symbol.items() if s >= self.size}
        self.strange = max(self.symbol.values()) + 1
        self.width = np.int64(self.strange + 0x110000)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for p, i in normal.items():
            for cut in range(1, len(p)):
                left, right = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = (order[scores[i]], i)
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()] + [NO_RANK], dtype=np.int64)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()] + [-1], dtype=np.int64)
        inner = [p for p in normal if len(p) > 1]
        alone = "".join(c for c in "\n\t\x0b\x0c" if not any(c in p for p in inner))
        if any(SPACE in p.lstrip(SPACE) for p in inner):
            raise ValueError("a piece holds a space after another character")
        stops = re.escape(alone)
        self.words = re.compile(f"[{stops}]|{SPACE}*[^{SPACE}{stops}]+|{SPACE}+" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def cut(self, text: str) -> list[str]:
        """Words of a text that merges never cross; the text gets a space in front unless it is empty.

        >>> # cut("a b") gives the words of "_a_b", "_a" and "_b", with "_" for the space mark
        """
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of every pair, NO_RANK and -1 where it makes no piece."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK), np.full(len(left), -1)
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != wanted] = len(self.keys)
        at[at > len(self.keys)] = len(self.keys)
        return self.ranks[at], self.merged[at]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of every word."""
        found: list[list[int]] = []
        start = 0
        while start < len(words):
            end, symbols = start + 1, len(words[start])
            while end < len(words) and symbols + len(words[end]) <= FLAT_SYMBOLS:
                symbols += len(words[end])
                end += 1
            found += self._flat(words[start:end])
            start = end
        return found

    def _flat(self, words: list[str]) -> list[list[int]]:
        known, strange = self.symbol, self.strange
        symbols = np.array([known[c] if c in known else strange + ord(c) for w in words for c in w], dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        out: list[list[int]] = [[] for _ in words]
        while len(symbols):
            symbols, owner, done, done_owner = self._round(symbols, owner)
            edges = np.flatnonzero(np.diff(done_owner)) + 1
            if len(done):
                for part, word in zip(np.split(done, edges), done_owner[np.concatenate(([0], edges))].tolist()):
                    out[word] = self._ids(part.tolist())
        return out

    def _round(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """One round over all words: what is left of them, and the symbols and owners of the words that are done."""
        n = len(symbols)
        rank, merged = np.full(n, NO_RANK), np.full(n, -1, dtype=np.int64)
        if n > 1:
            rank[:-1], merged[:-1] = self.pair(symbols[:-1], symbols[1:])
            rank[:-1][owner[:-1] != owner[1:]] = NO_RANK
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        length = np.diff(np.append(first, n))
        least = np.repeat(np.minimum.reduceat(rank, first), length)  # segmented minimum
        over = least == NO_RANK
        done, done_owner = symbols[over], owner[over]
        if over.any():
            keep = ~over
            symbols, owner, rank, merged, least = symbols[keep], owner[keep], rank[keep], merged[keep], least[keep]
            n = len(symbols)
            if not n:
                return symbols, owner, done, done_owner
        hit = rank == least
        # Every other pair of a run of overlapping pairs, from its left end.
        place = np.arange(n)
        begins = hit & ~np.concatenate(([False], hit[:-1]))
        run = np.maximum.accumulate(np.where(begins, place, -1))
        at = np.flatnonzero(hit & ((place - run) % 2 == 0))
        unsafe = self._unsafe(symbols, owner, merged, least, at)
        if len(unsafe):
            return *self._one_by_one(symbols, owner, at, merged, set(unsafe.tolist())), done, done_owner
        symbols = symbols.copy()
        symbols[at] = merged[at]
        keep = np.ones(n, dtype=bool)
        keep[at + 1] = False
        return symbols[keep], owner[keep], done, done_owner

    def _unsafe(self, symbols: np.ndarray, owner: np.ndarray, merged: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Words with more than one merge of which one makes a pair that is not worse than the rank merged now."""
        mine = owner[at]
        several = np.zeros(len(at), dtype=bool)
        same = mine[1:] == mine[:-1]
        several[1:] |= same
        several[:-1] |= same
        at, mine = at[several], mine[several]
        if not len(at):
            return mine
        made, rank = merged[at], least[at]
        bad = np.zeros(len(at), dtype=bool)
        after = at + 2
        inside = after < len(symbols)
        inside[inside] = owner[after[inside]] == mine[inside]
        bad[inside] |= self.pair(made[inside], symbols[after[inside]])[0] <= rank[inside]
        # On the left stands the result of the merge before, where it is adjacent.
        joins = np.concatenate(([False], (at[1:] == at[:-1] + 2) & (mine[1:] == mine[:-1])))
        before = np.maximum(at - 1, 0)
        left = np.where(joins, np.concatenate(([0], made[:-1])), symbols[before])
        inside = (at > 0) & (owner[before] == mine)
        bad[inside] |= self.pair(left[inside], made[inside])[0] <= rank[inside]
        return np.unique(mine[bad])

    def _one_by_one(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray, merged: np.ndarray, words: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The round of ``_round`` with the pairs of ``words`` merged in order, each with the pairs of the same rank that it makes."""
        listed = np.isin(owner[at], list(words))
        plain = at[~listed]
        symbols = symbols.copy()
        symbols[plain] = merged[plain]
        keep = np.ones(len(symbols), dtype=bool)
        keep[plain + 1] = False
        for word in words:
            low, high = np.searchsorted(owner, word), np.searchsorted(owner, word, "right")
            left = self._scan(symbols[low:high].tolist(), int(at[listed][np.searchsorted(owner[at[listed]], word)] - low))
            symbols[low : low + len(left)] = left
            keep[low + len(left) : high] = False
        return symbols[keep], owner[keep]

    def _scan(self, row: list[int], at: int) -> list[int]:
        """Merges of one word at the rank of the pair at ``at``, its leftmost of the smallest rank, until a smaller rank appears.

        One pass: what is left of the merge is settled, so only the pair in front of a merge can become the leftmost.
        """
        rank, _ = self._pair(row[at], row[at + 1])
        settled, rest = row[:at], row[:at - 1 if at else None:-1]  # the rest has its first symbol at the end
        while rest:
            settled.append(rest.pop())
            smaller = False
            while len(settled) > 1 or rest:
                # The pair in front of the last settled symbol comes before the pair behind it.
                ahead = self._pair(settled[-2], settled[-1]) if len(settled) > 1 else (NO_RANK, -1)
                behind = self._pair(settled[-1], rest[-1]) if rest else (NO_RANK, -1)
                if min(ahead[0], behind[0]) < rank:
                    smaller = True
                    break
                if ahead[0] == rank:
                    settled[-2:] = [ahead[1]]
                elif behind[0] == rank:
                    settled[-1] = behind[1]
                    rest.pop()
                else:
                    break
            if smaller:
                break
        return settled + rest[::-1]

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        key = left * int(self.width) + right
        at = int(np.searchsorted(self.keys, key))
        return (int(self.ranks[at]), int(self.merged[at])) if at < len(self.keys) and int(self.keys[at]) == key else (NO_RANK, -1)

    def _ids(self, symbols: list[int]) -> list[int]:
        """Piece ids of symbols; a character that is no piece becomes the ids of its bytes."""
        ids = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                ids += [self.byte_ids[b] for b in self._strange(s).encode()]
        return ids

    def _strange(self, symbol: int) -> str:
        return chr(symbol - self.strange) if symbol >= self.strange else self.inner[symbol]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        return [i for ids in self.encode_words(self.cut(text or "")) for i in ids]

    def decode(self, ids: list[int]) -> str:
        """Text of ids: a first piece loses the space in front, bytes that are no UTF-8 become U+FFFD each; other ids end a run of bytes."""
        text, run = [], b""
        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.bytes_of[i]
                continue
            if run:
                text.append(_characters(run))
                run = b""
            own = self.bytes_of[i].decode()
            if own:
                text.append(own if text or self.kinds[i] != NORMAL else own.removeprefix(" "))
        return "".join([*text, _characters(run)])


def _characters(data: bytes) -> str:
    return data.decode("utf-8", "each_bad_byte")


codecs.register_error("each_bad_byte", lambda e: ("\ufffd" * (e.end - e.start), e.end))


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def _remembered(path: str) -> list[dict[str, tuple[int, str, bytes]]]:
    """The older and the recent generation of known words, kept by a worker between its tasks."""
    return [{}, {}]


@dataclass(frozen=True)
class PieceEncoder:
    """A model file whose path every executor can read."""

    model_file: str

    def token_ids(self, text: Column) -> Column:
        """Ids of a whole text as an array; a null text has none."""
        this = self

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(this.model_file)
            for series in texts:
                yield pd.Series([model.encode(t) for t in series])

        return apply(text)

    def text_of(self, ids: Column) -> Column:
        """Text that an array of ids decodes to; null stays null."""
        this = self

        @F.pandas_udf(T.StringType())
        def apply(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load(this.model_file)
            for series in rows:
                yield pd.Series([None if r is None else model.decode(list(r)) for r in series])

        return apply(ids)

    def digest(self, text: Column) -> Column:
        """A struct (n_tokens, ids_sha256, decoded_sha256) of a whole text, without sending its ids back.

        ids_sha256 is over the decimal ids joined by commas, decoded_sha256 over the UTF-8 bytes of the text that the ids
        decode to. A null text counts as empty.
        """
        this = self
        result = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

        @F.pandas_udf(result)
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in texts:
                rows, waiting, size = [], [], 0
                for text in series:
                    waiting.append(text or "")
                    size += len(waiting[-1])
                    if size >= FLAT_SYMBOLS:
                        rows += this.digests(waiting)
                        waiting, size = [], 0
                yield pd.DataFrame(rows + this.digests(waiting), columns=result.names)

        return apply(text)

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of every text; words that are not known yet are merged together."""
        model, generations = load(self.model_file), _remembered(self.model_file)
        older, recent = generations
        cut = [model.cut(t) for t in texts]
        known: dict[str, tuple[int, str, bytes]] = {}
        missing = []
        for word in set().union(*cut):
            row = recent.get(word)
            if row is None:
                row = older.get(word)
                if row is None:
                    missing.append(word)
                    continue
                recent[word] = row
            known[word] = row
        for word, ids in zip(missing, model.encode_words(missing)):
            row = len(ids), ",".join(map(str, ids)), b"".join([model.bytes_of[i] for i in ids])
            known[word] = row
            if len(word) <= CACHE_CHARS:
                if len(recent) >= CACHE_WORDS:
                    recent = {}
                    generations[:] = [generations[1], recent]
                recent[word] = row
        out = []
        for words in cut:
            rows = [known[w] for w in words]
            decoded = b"".join([r[2] for r in rows])
            # Words of a text hold whole characters and begin with the space in front.
            out.append((sum([r[0] for r in rows]), hashlib.sha256(",".join([r[1] for r in rows]).encode()).hexdigest(), hashlib.sha256(decoded.removeprefix(b" ")).hexdigest()))
        return out
