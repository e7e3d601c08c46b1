"""The line deduplication of the query against brute force over all lines that are not blank."""

from __future__ import annotations

from varve.llm import line_dedup
from varve.llm.queries import op9_line_dedup

DOCS = "doc_id long, text string"


def test_short_lines_are_deduplicated(spark, sf, tmp_path):
    rows = [(1, "All rights reserved.\n\n- \nx"), (2, "All rights reserved.\n\n- "), (3, "All rights reserved\n \n \nx"), (4, None), (5, "")]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.dropped_lines for r in op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 2], 3: [3], 4: [], 5: []}


def test_every_equal_line_goes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    seen, want = set(), set()
    for r in sorted(docs.where("text is not null").collect(), key=lambda r: r.doc_id):
        for i, line in enumerate(r.text.split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                if line in seen:
                    want.add((r.doc_id, i))
                seen.add(line)
    assert want <= set(map(tuple, line_dedup.find_duplicates(docs, line_dedup.WHOLE).collect()))


def _brute(texts: dict[int, str | None]) -> set[tuple[int, int]]:
    """Union-find over all non-blank lines: equal ones, and similar ones within each step."""
    places: dict[str, list[tuple[int, int]]] = {}
    for doc, text in texts.items():
        for i, line in enumerate(text.split("\n") if text is not None else []):
            if line.strip(" \t\n\x0b\x0c\r"):
                places.setdefault(line, []).append((doc, i))
    parent = {line: line for line in places}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, least, most in line_dedup.WHOLE.steps:
        sets = {line: {line[i : i + k] for i in range(len(line) - k + 1)} for line in places if least <= len(line) <= most}
        holders: dict[str, list[str]] = {}
        for line, one in sets.items():
            for other in {o for s in one for o in holders.get(s, ())}:
                both = len(one & sets[other])
                if 5 * both >= 4 * (len(one) + len(sets[other]) - both):
                    parent[root(line)] = root(other)
            for s in one:
                holders.setdefault(s, []).append(line)
    groups: dict[str, list[tuple[int, int]]] = {}
    for line, where in places.items():
        groups.setdefault(root(line), []).extend(where)
    return {place for where in groups.values() for place in where if place != min(where)}


def test_one_edit_links_short_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.orderBy("doc_id").limit(60).collect()}
    base = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!$%&/()=?+-_<>äöüß"
    lengths = [29, 35, 48, 49, 56, 64, 65, 80]
    for n in lengths:
        texts[10**6 + n] = base[-n:]
        texts[2 * 10**6 + n] = base[-n:][: n // 2] + "#" + base[-n:][n // 2 + 1 :]
    # A chain over both steps: 44 and 52 characters meet in the first only, 52 and 64 in the second as well.
    texts |= {3 * 10**6 + n: "".join(chr(0x4E00 + i) for i in range(n)) for n in (44, 52, 64, 78)}
    frame = spark.createDataFrame(list(texts.items()), DOCS)
    got = set(map(tuple, line_dedup.find_duplicates(frame, line_dedup.WHOLE).collect()))
    assert {(2 * 10**6 + n, 0) for n in lengths} | {(3 * 10**6 + n, 0) for n in (52, 64, 78)} <= got
    assert got == _brute(texts)
