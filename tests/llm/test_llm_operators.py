"""Operators of the subpackage against brute force, library results, round trips and held-out accuracy."""

from __future__ import annotations

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from varve.llm import byte_bpe, compression_langid, decontaminate, line_dedup, near_dedup, pairwise_quality, quality_rules, queries, token_records, url_filter, warc
from varve.operators.staging import Workspace

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "no id here at all"), (4, "x" * 200_000), (5, "é ß 漢字   \x85 word")]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("kept", F.lit("clash"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_redirects_carry_blocks_and_allow_wins(spark):
    link = '<html><link rel="canonical" href="{}"></html>'
    pages = spark.createDataFrame(
        [
            (1, "http://alias.test/a", link.format("https://bad.net/x")),
            (2, "https://bad.net/x", ""),
            (3, "http://www.alias.test/a/?utm_source=f", None),
            (4, "http://both.test/", '<meta http-equiv="refresh" content="0; url=https://bad.net/y">'),
            (5, "https://bad.net/y", link.format("https://example.net/en/ok")),
            (6, None, ""),
            (7, "no scheme", ""),
            (8, "https://clean.test/", ""),
        ],
        "page_id long, url string, html string",
    )
    got = {r.page_id: r for r in url_filter.judge_urls(pages.select("page_id", "url"), url_filter.equivalence_edges(pages), queries.URL_RULES).collect()}
    assert {k: r.verdict for k, r in got.items()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    assert got[1].inherited and not got[2].inherited and (got[6].host, got[6].path, got[6].rule) == ("", "", None)


def test_joined_rules_judge_like_inline_rules(spark, monkeypatch):
    urls = spark.createDataFrame([(h, p) for h in ("a.net", "example.net", "b.example.com", "org", "x.org") for p in ("", "/", "/en/1", "/de/2", "/fr/3")], "host string, path string")
    inline = set(url_filter.match_rules(urls, queries.URL_RULES).collect())
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert set(url_filter.match_rules(urls, queries.URL_RULES).select("host", "path", "rule", "rule_action").collect()) == inline


def test_ablations_count_from_bits(spark, odd, empty):
    rows = quality_rules.ledger(quality_rules.measure(odd))
    got = {(r.policy, r.rule): r for r in quality_rules.ablations(rows).collect()}
    assert got["base", "too_few_words"].failed == rows.where("n_words < 50").count() == 7
    assert got["base", "repeated_words"].failed == 0
    assert quality_rules.measure(empty).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same"), (3, "http://b/", "same"), (2, None, "other\r\n\r\nx"), (4, "u", None), (5, "u", ""), (3, "http://c/", "same"), (None, "n", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = warc.archive(pages)
    got = sorted(map(tuple, warc.read_records(index).collect()), key=repr)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, 4, digest("same"), "revisit", 3), (3, 4, digest("same"), "response", None), (3, 4, digest("same"), "revisit", 3), (2, 10, digest("other\r\n\r\nx"), "response", None)]
    want += [(4, 0, digest(""), "revisit", 5), (5, 0, digest(""), "response", None), (None, 5, digest("alone"), "response", None)]
    assert got == sorted(want, key=repr)
    one = index.first()
    reader = warc.BundleReader(one.bundle)
    assert reader.record(one.frame, one.offset, one.length).startswith(b"WARC/1.1\r\n")
    assert warc.read_records(warc.archive(pages.limit(0))).count() == 0


def test_near_duplicates_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(odd).collect()}
    assert got[1].n_shingles == got[2].n_shingles == 0 and got[3].n_shingles == 1 and got[None].kept
    assert all(r.kept for r in got.values())
    assert near_dedup.near_duplicates(empty).count() == 0


def test_sequential_pruning_keeps_what_reaches_the_threshold():
    rng = np.random.default_rng(1)
    p = near_dedup.NearDedup(percent=80)
    common = rng.integers(0, 2**63, 900, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, rng.integers(0, 2**63, 50, dtype=np.uint64)])) for _ in range(40)]
    sig = near_dedup.signatures(sets, p.hashes)
    from varve.llm.minhash import prune, tile_pairs

    n = len(sets)
    ids, tile, side, band = np.arange(n), np.zeros(n, dtype=int), np.full(n, 2), np.full(n, -1)
    pairs = list(tile_pairs(tile, side, most=100))
    assert sum(len(x) for x, _ in pairs) == n * (n - 1) // 2
    kept = sum(len(prune(p, p.least_matches(), x, y, ids, ids, np.full(n, 950), sig, band)[0]) for x, y in pairs)
    assert kept == n * (n - 1) // 2


def test_quality_on_held_out_documents(spark, sf, docs, odd):
    model = pairwise_quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    held = docs.where(pairwise_quality.is_held_out(F.col("doc_id"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality is not null")
    rows = held.select("quality", model.score(F.col("text")).alias("score")).collect()
    assert sum((r.score >= pairwise_quality.ACCEPT) == (r.quality == 1) for r in rows) >= 0.85 * len(rows)
    assert all(0 <= r.score <= 1 for r in odd.select(model.score(F.col("text")).alias("score")).collect())


def test_quality_without_labels_accepts_all(spark, docs):
    model = pairwise_quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert docs.limit(3).select(model.score(F.col("text")).alias("s")).where(f"abs(s - {pairwise_quality.ACCEPT}) > 1e-9").count() == 0


def test_language_on_held_out_documents(docs, odd):
    held_out = pairwise_quality.is_held_out(F.col("doc_id"))
    model = compression_langid.fit(docs, ~held_out)
    rows = docs.where(held_out).where("lang is not null and length(text) > 60").select("lang", model.predict(F.col("text")).alias("p")).collect()
    assert sum(r.lang == r.p.lang_pred for r in rows) >= 0.9 * len(rows)
    got = {r.doc_id: r.p for r in odd.select("doc_id", model.predict(F.col("text")).alias("p")).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[1].score == 0


def test_token_records_equal_the_tokenizer(spark, odd, docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_records.WordEncoder(path)
    ws = Workspace(spark, "test")
    segments = token_records.archive(docs, encoder, f"{ws.root}/records")
    start = 0
    got = {r.doc_id: r for r in token_records.read_documents(segments).collect()}
    for key in sorted(texts):
        ids = np.array([*tokenizer.encode(texts[key] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (got[key].start, got[key].n_tokens, got[key].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = segments.orderBy("file").first()
    first, _ = token_records.read_record(one.file, 0)
    third, ids = token_records.read_record(one.file, 2)
    assert sorted(texts).index(third) == sorted(texts).index(first) + 2 and len(ids) == got[third].n_tokens
    odd_rows = {r.doc_id: r.n_tokens for r in token_records.read_documents(token_records.archive(odd, encoder)).collect()}
    assert odd_rows[1] == odd_rows[2] == 1 and None in odd_rows


def test_byte_bpe_equals_the_library(odd, docs, texts):
    import tiktoken

    bpe = byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.tables[0], special_tokens={})
    for frame, known in ((docs, texts), (odd, dict(ODD))):
        for r in frame.select("doc_id", bpe.digest(F.col("text")).alias("d")).select("doc_id", "d.*").collect():
            text = known[r.doc_id] or ""
            ids = library.encode_ordinary(text)
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def _brute_lines(texts: dict[int, str | None], k: int, percent: int, least: int) -> set[tuple[int, int]]:
    places: dict[str, list[tuple[int, int]]] = {}
    for doc, text in texts.items():
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            if len(line) >= least:
                places.setdefault(line, []).append((doc, i))
    sets = {line: {line[i : i + k] for i in range(len(line) - k + 1)} for line in places}
    holders: dict[str, list[str]] = {}
    parent = {line: line for line in places}

    def root(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for line, one in sets.items():
        seen = {other for s in one for other in holders.get(s, ())}
        for other in seen:
            both = len(one & sets[other])
            if 100 * both >= percent * (len(one) + len(sets[other]) - both):
                parent[root(line)] = root(other)
        for s in one:
            holders.setdefault(s, []).append(line)
    groups: dict[str, list[tuple[int, int]]] = {}
    for line, where in places.items():
        groups.setdefault(root(line), []).extend(where)
    return {place for where in groups.values() for place in where if place != min(where)}


def test_line_dedup_equals_brute_force(spark, docs, texts, odd, empty):
    p = line_dedup.LineDedup()
    some = {k: texts[k] for k in sorted(texts)[:120]}
    base = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest at night number "
    some |= {10**6 + i: base + str(i) + "\nshort\n" + base for i in range(30)}
    frame = spark.createDataFrame(list(some.items()), DOCS)
    got = {(r.doc_id, r.line_no) for r in line_dedup.find_duplicates(frame).collect()}
    assert got == _brute_lines(some, p.shingle, p.percent, p.min_chars)
    cleaned = {r.doc_id: r.text for r in line_dedup.drop_lines(frame, line_dedup.find_duplicates(frame)).collect()}
    assert cleaned[10**6 + 5] == "short"
    assert line_dedup.summary(odd, line_dedup.find_duplicates(odd)).count() == len(ODD)
    assert line_dedup.find_duplicates(empty).count() == 0


def test_templates_match_other_numbers_and_names_with_consistent_slots(spark, empty):
    item = "A farmer named Carla has 12 cows and buys 7 more cows from Peter before the market closes, so how many cows has Carla now ?"
    twin = "Some text first. A farmer named Lucia has 45 cows and buys 9 more cows from Bruno before the market closes, so how many cows has Lucia now ?"
    twisted = twin.replace("has Lucia now", "has Bruno now")
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, twin), (2, twisted), (3, "Nothing of the kind is asked in this sentence about cows."), (4, None), (5, ""), (6, item), (6, item)], DOCS)
    pairs = decontaminate.contamination(docs, items)
    got = {r.doc_id: r.contaminated for r in decontaminate.judge(docs, pairs).collect()}
    assert got[1] and got[6] and not (got[2] or got[3] or got[4] or got[5])
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_exact_benchmark_items_are_found(spark, sf):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    docs = items.select((F.col("item_id") + 10).alias("doc_id"), F.concat(F.lit("Before it. "), "text", F.lit(" After it.")).alias("text"))
    docs = docs.where(F.size(F.split("text", " ")) > 25)
    found = decontaminate.contamination(docs, items).select("doc_id").distinct().count()
    assert found == docs.count()


def test_pipeline_stages(spark, sf, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminated", "tokens"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    rows = pipeline.run(spark, sf).collect()
    assert 0 < len(rows) <= len(ids) and {r.doc_id for r in rows} <= ids
    assert len({r.ids_sha256 for r in rows}) == len(rows)
