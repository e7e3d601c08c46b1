"""Decontamination of whole families, near-verbatim copies and short items."""

from __future__ import annotations

import pytest

from varve.llm import decontaminate

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def _found(spark, items, docs) -> set[tuple[int, int]]:
    pairs = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    return {(r.doc_id, r.item_id) for r in pairs.collect()}


def test_items_of_one_template_are_all_reported(spark):
    text = "the farmer has {} cows and then buys {} more cows at noon"
    items = [(1, text.format(3, 3)), (2, text.format(3, 5)), (3, text.format(8, 6))]
    docs = [(1, "It said: " + text.format(4, 9)), (2, text.format(7, 7)), (3, "nothing of this kind is asked here")]
    assert _found(spark, items, docs) == {(1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_one_differing_slot_does_not_hide_a_copy(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60)]
    words[3] = words[20] = words[50] = "12"
    copy = [*words[:50], "13", *words[51:]]
    assert _found(spark, [(1, " ".join(words))], [(1, " ".join(copy))]) == {(1, 1)}


SHORT = ["12 + 7 * 3 = 40", "Carla has 12 cows", "Where is Paris", "The farmer has 12 cows and 7 pigs", "7 8 9 10 11 12 13 14 15 16", "Six cows of Peter ate 3 kg in 2 days on 9 fields near Rome"]


@pytest.mark.parametrize("around", [("and so ", " as we know"), ("Before it. ", " After it."), ("they wrote 5 ", " 3 times")])
def test_every_item_is_found_in_mid_sentence(spark, sf, around):
    items = [(i, t) for i, t in enumerate(SHORT, 10**6)] + [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    found = _found(spark, items, [(i, around[0] + t + around[1]) for i, t in items])
    assert {(i, i) for i, _ in items} <= found


def test_other_numbers_in_mid_sentence(spark):
    items = [(1, "The farmer has 12 cows and 7 pigs")]
    assert _found(spark, items, [(1, "we know The farmer has 15 cows and 2 pigs today"), (2, "we know that Peter ate 15 cows and 2 pigs today")]) == {(1, 1)}
