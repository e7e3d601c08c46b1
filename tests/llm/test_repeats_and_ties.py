"""Repeated ids, ties and odd characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.llm import compression_langid, line_dedup, near_dedup, url_filter

WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def test_rows_of_one_id_are_linked_through_all_their_texts(spark):
    x, y = " ".join(WORDS), " ".join(reversed(WORDS))
    docs = spark.createDataFrame([(0, x), (1, x), (1, y), (5, y), (7, "quite another text of some words here")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(0, 0), (1, 0), (5, 0), (7, 7)}


def test_lines_go_only_where_their_content_was_marked(spark):
    twice = "this line is found in two of the documents here"
    own = "but this line occurs in no other place of the table"
    docs = spark.createDataFrame([(1, f"first\n{twice}"), (2, f"second\n{twice}"), (2, f"third\n{own}")], "doc_id long, text string")
    cleaned = line_dedup.drop_lines(docs, line_dedup.mark_duplicates(docs, line_dedup.WHOLE))
    assert sorted((r.doc_id, r.text) for r in cleaned.collect()) == [(1, f"first\n{twice}"), (2, "second"), (2, f"third\n{own}")]


def test_rules_of_equal_length_have_one_order(spark, monkeypatch):
    urls = spark.createDataFrame([("a.net", "/bc")], "host string, path string")
    rules = [("block", "net/bc"), ("block", "a.net/")]
    inline = url_filter.match_rules(urls, rules).first()
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    assert inline.rule == url_filter.match_rules(urls, rules).first().rule == "a.net/"


def test_relative_links_and_observed_redirects(spark):
    head = '<link rel="canonical" href="{}">'
    pages = spark.createDataFrame(
        [("http://a.org/x/y?q=1", head.format("../z&amp;w")), ("http://a.org/x/y", head.format("./k/")), ("http://b.org/", None)], "url string, html string"
    )
    found = {tuple(r) for r in url_filter.page_edges(pages).collect()}
    assert found == {("http://a.org/x/y?q=1", "http://a.org/z&w"), ("http://a.org/x/y", "http://a.org/x/k/")}
    seen = spark.createDataFrame([("http://b.org/", "http://c.org/"), (None, "http://c.org/")], "from_url string, to_url string")
    edges = url_filter.equivalence_edges(pages, redirects=seen, aliases=False)
    assert {tuple(r) for r in edges.collect()} == found | {("http://b.org/", "http://c.org/")}


def test_only_letters_make_a_language(spark):
    docs = spark.createDataFrame([(i, f"some words of a text {i}", "en") for i in range(4)] + [(9, "² ½ ³", None), (10, "long " * 1000, "de")], "doc_id long, text string, lang string")
    model = compression_langid.fit(docs, F.lit(True))
    assert sorted(model.dictionaries) == ["de", "en"] and len(model.dictionaries["de"]) == 5001
    assert docs.where("doc_id = 9").select(model.predict(F.col("text")).alias("p")).first().p.lang_pred == "und"
