"""Merkle manifest: paths by treehash against whole trees, proofs, ties, nulls and empty tables."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from varve.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf int, seen int, pos int"


def _levels(nodes: list[str]) -> list[list[str]]:
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([merkle.node_hash("".join(found[-1][i : i + 8])) for i in range(0, len(found[-1]), 8)])
    return found


def _path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    path = []
    for nodes in levels[:-1]:
        first = at // 8 * 8
        run = nodes[first : first + 8]
        path.append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        at //= 8
    return path


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 500, 512])
def test_paths_of_a_block_equal_those_of_the_whole_tree(n):
    leaves = [merkle.node_hash(str(i)) for i in range(n)]
    levels = _levels(leaves)
    assert merkle.block_root(leaves, merkle.height(n)) == levels[-1][0]
    paths = list(merkle.authentication_paths(leaves, merkle.height(n)))
    assert paths == [",".join(f"{a}:{b}" for a, b in _path(levels, i)) for i in range(n)]
    assert all(merkle.fold(leaf, path) == levels[-1][0] for leaf, path in zip(leaves, paths))


def test_stacks_stay_logarithmic():
    leaves = [merkle.node_hash(str(i)) for i in range(512)]
    stack = merkle.Treehash(leaves, 3)
    held = 0
    for _ in leaves:
        stack.step()
        held = max(held, sum(map(len, stack.open)))
    assert held <= 8 * 4


def _leaf(row, tampered: bool) -> str:
    text = row["text"]
    if tampered and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return merkle.node_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def _expected(rows: list[dict]) -> list[tuple]:
    of_lang: dict = {}
    for r in rows:
        of_lang.setdefault(r["lang"], []).append(r)
    langs = sorted(of_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(of_lang[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, False)))
        trees[lang] = ordered, _levels([_leaf(r, False) for r in ordered])
    top = _levels([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        ordered, levels = trees[lang]
        for i, r in enumerate(ordered):
            path = _path(levels, i) + _path(top, k)
            node = _leaf(r, r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0)
            for left, right in path:
                node = merkle.node_hash(left + node + right)
            root = top[-1][0]
            out.append((r["doc_id"], levels[0][i], levels[-1][0], root, merkle.node_hash("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def _result(docs):
    return merkle.manifest(merkle.document_leaves(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0))


def test_nulls_ties_long_texts_and_many_blocks(spark):
    rows = [{"doc_id": i, "text": f"Text {i}", "lang": "de" if i % 5 else None, "source": "s", "n_chars": i} for i in range(1500)]
    rows += [{"doc_id": 3, "text": "Text 3", "lang": "de", "source": "s", "n_chars": 3}] * 3  # repeated rows
    rows += [{"doc_id": 7, "text": t, "lang": "de", "source": None, "n_chars": None} for t in (None, "", "É" * 200_000, "other")]
    rows += [{"doc_id": None, "text": "No id", "lang": "ü", "source": "s", "n_chars": 1}, {"doc_id": 9, "text": "Alone", "lang": "", "source": "s", "n_chars": 1}]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, 2, 3) for r in rows], SCHEMA)
    assert sorted(map(tuple, _result(docs).collect()), key=repr) == _expected(rows)


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(6, "x", "de", "s", 1, 0, 0, 0)], SCHEMA)
    (row,) = _result(one).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == merkle.node_hash("")
    assert _result(one.limit(0)).collect() == []
