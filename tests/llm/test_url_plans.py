"""The plans of the URL filter stay small enough to be made at once."""

from __future__ import annotations

from varve.llm import url_filter


def test_plans_stay_short(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for edges in (url_filter.page_edges(pages), url_filter.alias_edges(pages.select("url")), url_filter.equivalence_edges(pages)):
        assert len(edges._jdf.queryExecution().optimizedPlan().toString()) < 200_000


def test_aliases_of_null_and_repeated_urls(spark):
    urls = spark.createDataFrame([(None,), ("http://www.A.de/x/?utm_a=1",), ("http://www.A.de/x/?utm_a=1",), ("ftp://b.de/",), ("no url",)], "url string")
    assert [tuple(r) for r in url_filter.alias_edges(urls).collect()] == [("http://www.a.de/x/?utm_a=1", "https://a.de/x")]
