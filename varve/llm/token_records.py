"""Token ids as length-delimited binary records.

A data file is a sequence of frames in the TFRecord layout: 8 bytes of little-endian length, the
masked CRC-32C of those 8 bytes, the record, the masked CRC-32C of the record. A separate index
file holds the 8-byte offset of every frame, so a shuffled reader seeks to any record. A record is
a 16-byte head (flags, number of ids, document id) and the ids as little-endian unsigned integers of
2 bytes if the vocabulary fits, else 4, padded with zeros to a multiple of 4 bytes.
"""

from __future__ import annotations

import os
import re
import string
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.batches import sized_slices
from varve.llm.shared_files import AtomicFile, filesystem
from varve.operators.staging import Workspace

HEAD, HEAD_BYTES = "<IIq", 16
NULL_ID, WIDE_IDS = 1, 2
#: CRC-32C polynomial in reflected form, and the constant added by masking.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8
ASCII_LETTERS, MARKS = string.ascii_letters, string.punctuation.replace("'", "")
#: Letters and bytes of other scripts, then ASCII marks without the apostrophe.
_MARKED = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]+)")
#: Letters from here on are left to the tokenizer together with the marks after them.
PARTED = "\u0530"
#: Bytes of record files that one task reads back.
READ_BYTES = 1 << 24
#: Words whose ids a worker remembers in each of two generations.
CACHE_WORDS = 500_000
SEGMENT_SCHEMA = "file string, part int, segment int, first long, records long, begin long, end long, ids_before long, ids long"
DOCUMENT_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


@lru_cache(maxsize=64)
def _advance(zero_bytes: int) -> np.ndarray:
    """Four tables of 256 that carry a CRC state over so many zero bytes (a power of two, at least 4)."""
    if zero_bytes == 4:
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(CASTAGNOLI), table >> 1).astype(np.uint32)
        rows = [table]
        for _ in range(3):
            rows.append((rows[-1] >> 8) ^ table[rows[-1] & 0xFF])
        return np.stack(rows[::-1])
    half = zero_bytes // 2
    return np.stack([_carry(_carry(np.arange(256, dtype=np.uint32) << np.uint32(8 * k), half), half) for k in range(4)])


def _carry(state: np.ndarray, zero_bytes: int) -> np.ndarray:
    t = _advance(zero_bytes)
    return t[0][state & 0xFF] ^ t[1][(state >> 8) & 0xFF] ^ t[2][(state >> 16) & 0xFF] ^ t[3][state >> 24]


def masked_crc32c(records: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of every record; lengths must be multiples of 4.

    A CRC is linear and leading zeros do not change its zero-start part, so records are padded in
    front to powers of two and folded pairwise, all records of a size class at once.
    """
    words = np.array([len(r) // 4 for r in records], dtype=np.int64)
    out = np.zeros(len(records), dtype=np.uint32)
    classes = np.array([max(int(w - 1).bit_length(), 0) if w else 0 for w in words])
    for size in np.unique(classes):
        members = np.flatnonzero(classes == size)
        grid = np.zeros((len(members), 1 << int(size)), dtype=np.uint32)
        for row, k in enumerate(members):
            if words[k]:
                grid[row, -words[k] :] = np.frombuffer(records[k], dtype="<u4")
        state, span = _carry(grid, 4), 4
        while state.shape[1] > 1:
            state = _carry(state[:, 0::2], span) ^ state[:, 1::2]
            span *= 2
        out[members] = state[:, 0]
    start = np.full(len(records), 0xFFFFFFFF, dtype=np.uint32)
    for bit in range(int(words.max(initial=0)).bit_length()):
        moved = (words >> bit) & 1 == 1
        start[moved] = _carry(start[moved], 4 << bit)
    crc = ~(start ^ out)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


@dataclass(frozen=True)
class WordEncoder:
    """Ids of whole texts by a tokenizer file whose pre-tokenizer never joins across white space.

    ``end_id`` closes every document. White-space separated words are encoded once per batch and
    remembered, which gives the ids of encoding the text at once.
    """

    tokenizer_file: str
    end_id: int = 1

    @property
    def width(self) -> int:
        """Bytes of a stored id."""
        return 2 if max(_tokenizer(self.tokenizer_file).get_vocab_size(), self.end_id) <= 1 << 16 else 4

    def batch(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of every text with the end id, as stored; a null text is empty."""
        folds, cuts = _probed(self.tokenizer_file)
        column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(column) if folds else column)  # words, and empty ones at the edges
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        generations = _remembered(self.tokenizer_file)
        older, recent = generations
        ids_of = list(map(recent.get, words))
        missing = {w for w, ids in zip(words, ids_of, strict=True) if ids is None}
        if missing:
            fresh = {w: older[w] for w in missing if w in older}
            fresh |= self._ids_of(missing.difference(fresh), recent, cuts)
            recent.update(fresh)
            ids_of = [fresh[w] if ids is None else ids for w, ids in zip(words, ids_of, strict=True)]
        if len(recent) > CACHE_WORDS:
            generations[:] = [recent, {}]
        # Ids of the different words one after another, from which every word of the texts takes its run.
        store = np.frombuffer(b"".join(ids_of), dtype=f"<u{self.width}")
        sizes = np.array(list(map(len, ids_of)), dtype=np.int64) // self.width
        begins = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy()
        taken = sizes[at] if len(at) else np.zeros(0, dtype=np.int64)
        before = np.concatenate([[0], np.cumsum(taken)])
        ids = store[np.repeat(begins[at] - before[:-1], taken) + np.arange(before[-1])] if len(at) else store
        offsets = split.offsets.to_numpy()
        bounds = before[offsets - offsets[0]].tolist()
        end = self.end_id.to_bytes(self.width, "little")
        return [ids[i:j].tobytes() + end for i, j in zip(bounds, bounds[1:], strict=False)]

    def _ids_of(self, words: set[bytes], known: dict[bytes, bytes], cuts: bool) -> dict[bytes, bytes]:
        """Ids of words; letters and the marks after them are looked up apart where the tokenizer parts them anyway."""
        parts: dict[bytes, tuple[bytes, ...]] = {}
        for word in words:
            m = _MARKED.fullmatch(word) if cuts else None
            parts[word] = m.groups() if m and (word[m.end(1) - 1] < 128 or self._ends_in_letter(m[1].decode())) else (word,)
        pieces = {p for ps in parts.values() for p in ps}
        ids = {p: known[p] for p in pieces if p in known}
        fresh = list(pieces.difference(ids))
        ids |= zip(fresh, self._encode_words(fresh), strict=True)
        return ids | {w: b"".join([ids[p] for p in ps]) for w, ps in parts.items()}

    def _ends_in_letter(self, letters: str) -> bool:
        """Whether the normalized form ends in a letter of the scripts before ``PARTED``, and not in a mark that would join what follows."""
        normalizer = _tokenizer(self.tokenizer_file).normalizer
        last = (normalizer.normalize_str(letters) if normalizer else letters)[-1:]
        return last.isalpha() and last < PARTED

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        """Words joined by spaces, in groups; token offsets tell which word a token belongs to."""
        tokenizer = _tokenizer(self.tokenizer_file)
        width = self.width
        groups = [[w.decode() for w in words[i : i + 256]] for i in range(0, len(words), 256)]
        out: list[bytes] = []
        for group, found in zip(groups, tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ends = np.cumsum([len(w) + 1 for w in group])
            starts = np.fromiter((a for a, _ in found.offsets), dtype=np.int64, count=len(found.ids))
            cuts = np.searchsorted(starts, ends)
            data = np.array(found.ids, dtype=f"<u{width}").tobytes()
            at = 0
            for cut in cuts.tolist():
                out.append(data[width * at : width * cut])
                at = cut
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _probed(path: str) -> tuple[bool, bool]:
    """Whether a tokenizer ignores the case of A-Z, and whether it always parts a run of letters from the ASCII marks after it."""
    tokenizer = _tokenizer(path)
    folds = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str(ASCII_LETTERS) == ASCII_LETTERS.lower()
    parts = lambda text: [piece[1] for piece in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
    cuts = tokenizer.pre_tokenizer is not None and all(parts(f"ab{a}{b}") == [(0, 2), (2, 4)] for a in MARKS for b in MARKS)
    return folds, cuts and folds


@lru_cache(maxsize=2)
def _remembered(path: str) -> list[dict[bytes, bytes]]:
    return [{}, {}]


def write_records(
    docs: DataFrame, encoder: WordEncoder, folder: str, doc_id: str = "doc_id", text: str = "text", segment_bytes: int = 1 << 23
) -> DataFrame:
    """Write ``part-*.records`` and ``part-*.offsets`` in ascending id order (nulls first); returns the lazy table of segments.

    Ids are range-partitioned, so part numbers ascend with ids and no task sees more than its
    range. A segment is a run of about ``segment_bytes`` of one file, the unit of reading back.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        name = f"{folder}/part-{part:06d}"
        data = offsets = None
        segments, ids_before, done = [], 0, 0
        seg = {"first": 0, "begin": 0, "ids": 0}

        def close_segment() -> None:
            if done > seg["first"]:
                segments.append(
                    {"file": name, "part": part, "segment": len(segments), "first": seg["first"], "records": done - seg["first"],
                     "begin": seg["begin"], "end": data.size, "ids_before": ids_before - seg["ids"], "ids": seg["ids"]}
                )
            seg.update(first=done, begin=data.size, ids=0)

        for batch in sized_slices(batches, 4096, 1 << 24):
            if data is None:
                data, offsets = AtomicFile(f"{name}.records", attempt), AtomicFile(f"{name}.offsets", attempt)
            keys = batch.column(0).to_pylist()
            ids = encoder.batch(batch.column(1))
            records = [pack_record(k, i, encoder.width) for k, i in zip(keys, ids, strict=True)]
            lengths = [struct.pack("<Q", len(r)) for r in records]
            for n, record, length, a, b in zip(
                (len(i) // encoder.width for i in ids), records, lengths, masked_crc32c(lengths), masked_crc32c(records), strict=True
            ):
                offsets.write(struct.pack("<Q", data.size))
                data.write(b"".join((length, struct.pack("<I", a), record, struct.pack("<I", b))))
                done += 1
                ids_before += n
                seg["ids"] += n
                if data.size - seg["begin"] >= segment_bytes:
                    close_segment()
        if data is not None:
            close_segment()
            data.commit()
            offsets.commit()
        yield pa.RecordBatch.from_pylist(segments, schema=_SEGMENTS)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = chosen.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(write, SEGMENT_SCHEMA)


_SEGMENTS = pa.schema(
    [(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[k]) for n, k in (f.split() for f in SEGMENT_SCHEMA.split(", "))]
)


def read_frames(uri: str, begin: int, end: int) -> list[bytes]:
    """The records between two frame offsets of a data file, lengths and checksums verified."""
    files, path = filesystem(f"{uri}.records")
    with files.open_input_file(path) as file:
        data = file.read_at(end - begin, begin)
    records, lengths, sums, at = [], [], [], 0
    while at < len(data):
        length = data[at : at + 8]
        size = int.from_bytes(length, "little")
        lengths.append(length)
        records.append(data[at + 12 : at + 12 + size])
        sums.append((data[at + 8 : at + 12], data[at + 12 + size : at + 16 + size]))
        at += 16 + size
    stored = np.array([[int.from_bytes(x, "little") for x in pair] for pair in sums], dtype=np.uint32).reshape(-1, 2)
    if not (np.array_equal(stored[:, 0], masked_crc32c(lengths)) and np.array_equal(stored[:, 1], masked_crc32c(records))):
        raise ValueError(f"damaged record in {uri}")
    return records


def pack_record(doc_id: int | None, ids: bytes, width: int) -> bytes:
    flags = (NULL_ID if doc_id is None else 0) | (WIDE_IDS if width == 4 else 0)
    return struct.pack(HEAD, flags, len(ids) // width, doc_id or 0) + ids + b"\0" * (-len(ids) % 4)


def unpack_record(record: bytes) -> tuple[int | None, np.ndarray]:
    """The document id and the ids as unsigned 32-bit integers."""
    flags, count, key = struct.unpack_from(HEAD, record)
    ids = np.frombuffer(record, dtype="<u4" if flags & WIDE_IDS else "<u2", offset=HEAD_BYTES, count=count)
    return (None if flags & NULL_ID else key), ids.astype("<u4")


def read_record(uri: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record by its number in the file, through the offset index: (document id, ids)."""
    files, path = filesystem(f"{uri}.offsets")
    with files.open_input_file(path) as file:
        begin = int.from_bytes(file.read_at(8, 8 * number), "little")
    files, path = filesystem(f"{uri}.records")
    with files.open_input_file(path) as file:
        size = int.from_bytes(file.read_at(8, begin), "little")
    (record,) = read_frames(uri, begin, begin + size + 16)
    return unpack_record(record)


def read_documents(segments: DataFrame) -> DataFrame:
    """Per record: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids, read from the files."""
    files = segments.groupBy("file", "part").agg(F.sum("ids").alias("total"))
    # One row per file; the running total over files is the only global order needed.
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = files.select("file", F.coalesce(before, F.lit(0)).alias("base"))
    work = segments.join(bases, "file").select("file", "begin", "end", (F.col("base") + F.col("ids_before")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, starts, counts, sums, start = [], [], [], [], row["start"]
                for record in read_frames(row["file"], row["begin"], row["end"]):
                    key, ids = unpack_record(record)
                    keys.append(key)
                    starts.append(start)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (keys, starts, counts, sums)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # As many tasks as the files have bytes for; the table of segments itself is tiny and would be read by one.
    size = segments.agg(F.sum(F.col("end") - F.col("begin"))).first()[0] or 0
    tasks = max(-(-size // READ_BYTES), 1)
    return work.repartition(tasks, F.xxhash64("file", "begin")).mapInArrow(read, DOCUMENT_SCHEMA)


def archive(docs: DataFrame, encoder: WordEncoder, folder: str | None = None) -> DataFrame:
    """Encode and write all documents; returns the stored table of segments. A null text counts as empty."""
    ws = Workspace(docs.sparkSession, "tokens")
    return ws.table(write_records(docs, encoder, folder or f"{ws.root}/records"), "segments")
