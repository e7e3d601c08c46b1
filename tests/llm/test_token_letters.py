"""Ids of words with letters whose normalized form ends in a mark, against the tokenizer itself."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from varve.llm import token_records

PATH = public_tokenizers.path("word_bpe_49k.json")


def _ids(encoder: token_records.WordEncoder, texts: list[str]) -> list[list[int]]:
    return [np.frombuffer(data, dtype=f"<u{encoder.width}")[:-1].tolist() for data in encoder.batch(texts)]


@pytest.mark.parametrize("form", ["{}(", "a{}?(", "Kadir {}. x", "{}{}!!"])
def test_every_letter_before_punctuation(form):
    """All characters from U+0080 to U+FFFF that can stand in a text."""
    tokenizer, encoder = Tokenizer.from_file(PATH), token_records.WordEncoder(PATH)
    texts = [form.replace("{}", chr(c)) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000]
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, _ids(encoder, texts), want) if a != b] == []


def test_random_texts():
    tokenizer, encoder, pick = Tokenizer.from_file(PATH), token_records.WordEncoder(PATH), random.Random(8)
    texts = []
    for _ in range(20_000):
        wide = [chr(pick.choice([pick.randrange(0x80, 0x530), pick.randrange(0x80, 0xD800), pick.randrange(0xE000, 0x10000)])) for _ in range(4)]
        texts.append("".join(pick.choice([*wide, *"aZ .,(!'-"]) for _ in range(pick.randrange(12))))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, _ids(encoder, texts), want) if a != b] == []
