"""Spelling variants against a plain loop over all pairs, at several sizes of a range."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from varve.llm import spelling


def _near(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _expected(counts: dict[str, int], ratio: int = 10) -> set[tuple]:
    near = {w: [x for x in counts if _near(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda x: (-counts[x], x))
            if counts[best] >= ratio * counts[w]:
                form[w] = best

    def root(w: str) -> str:
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def _words(seed: int) -> dict[str, int]:
    """Families of near words of few letters, so that runs of equal letters and crowded ranges occur."""
    pick = random.Random(seed)
    counts = {}
    for _ in range(60):
        base = "".join(pick.choice("abé") for _ in range(pick.randrange(7, 12)))
        for _ in range(12):
            w, at = base, pick.randrange(len(base))
            kind = pick.randrange(4)
            w = w if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + pick.choice("abéz") + w[at + (kind == 2) :]
            if len(w) >= 7:
                counts[w] = pick.choice([2, 3, 20, 40, 400, 5000])
    return counts


@pytest.mark.parametrize("block", [2, 8, 192])
def test_pairs_and_chains_at_any_size_of_a_range(spark, block):
    counts = _words(block)
    words = spark.createDataFrame([(w, n, 0) for w, n in counts.items()], "word string, n long, form int").select("word", "n")
    found = spelling.variants(words, spelling.Spelling(block=block)).collect()
    assert {tuple(r) for r in found} == _expected(counts) and len(found) == len(counts)


def test_every_pair_once_and_lengths_far_apart(spark):
    counts = _words(1) | {"x" * 300: 2, "x" * 301: 50, "x" * 150 + "y" + "x" * 149: 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r.word, r.near) for r in spelling.neighbours(words, spelling.Spelling(block=4)).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, b) for a in counts for b in counts if _near(a, b)}


def test_a_crowded_range_is_split_without_loss(spark):
    """One prefix and one suffix hold all words; only words that differ in the same place may stay together."""
    pick = random.Random(3)
    words = {"abcdefgh" + "".join(pick.choice("pqrs") for _ in range(6)) + "stuvwxyz": pick.randrange(2, 99) for _ in range(700)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    found = spelling.variants(table, spelling.Spelling(block=16)).collect()
    assert {tuple(r) for r in found} == _expected(words)


def test_words_of_documents(spark):
    rows = [(1, "Haupthaus, HAUPTHAUS haupthaus×x é"), (2, None), (3, ""), (None, "Nachbarn nachbarn"), (5, "kurz " * 3), (6, "wiederholung " * 4000)] + [(i, f"Strasse{'é' * (i % 3)} strassen gartenzaun") for i in range(10, 400)]
    rows += [(77, "strassen"), (77, "strassen")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    counts: Counter = Counter()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    p = spelling.Spelling()
    assert {tuple(r) for r in spelling.variants(spelling.vocabulary(spelling.document_words(docs), p), p).collect()} == _expected(counts)
    assert spelling.variants(spelling.vocabulary(spelling.document_words(docs.limit(0)), p), p).collect() == []
