"""URL filters with redirect equivalence (DataFrame and SQL functions only).

Rules name a host and a path prefix. A URL without a rule of its own takes the verdict of the
URLs it is equivalent to: redirect and canonical-link edges are closed into components by
distributed connected components, and block decisions spread over a component unless one of
its members is explicitly allowed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators.components import connected_components
from varve.operators.staging import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are evaluated as expressions in the scan; more are joined by host.
INLINE_RULES = 64


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def url_node(url: Column) -> Column:
    """The resource a URL names: scheme and host in lower case, no fragment, ``/`` for an empty path; null without ``://``."""
    at = F.instr(url, "://")
    scheme = F.translate(F.substring(url, F.lit(1), at + 2), UPPER, LOWER)
    path = url_path(url)
    query = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(at > 0, F.concat(scheme, url_host(url), F.when(path == "", "/").otherwise(path), query))


def _split_rule(rule: str) -> tuple[str, str]:
    host, _, path = rule.partition("/")
    return host.translate(str.maketrans(UPPER, LOWER)), "/" + path


def match_rules(urls: DataFrame, rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> DataFrame:
    """Add ``rule`` and ``rule_action``: the longest rule that fits, at equal length allow before block and then the first by name, null if none.

    ``rules`` are ``(action, "host/prefix")``; a rule fits its host and all subdomains.
    """
    if len(rules) <= INLINE_RULES:
        ranked = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
        h, p = F.col(host), F.col(path)

        def fits(rule: str) -> Column:
            name, prefix = _split_rule(rule)
            return ((h == name) | h.endswith("." + name)) & p.startswith(prefix)

        def first(pick) -> Column:
            tests = [(fits(r[1]), pick(r)) for r in ranked]
            return reduce(lambda c, t: c.when(*t), tests[1:], F.when(*tests[0])) if tests else F.lit(None).cast("string")

        return urls.withColumns({"rule": first(lambda r: r[1]), "rule_action": first(lambda r: r[0])})
    spark = urls.sparkSession
    rows = [(*_split_rule(rule), rule, action, len(rule) * 2 + (action == "allow")) for action, rule in rules]
    table = spark.createDataFrame(rows, "rule_host string, prefix string, rule string, rule_action string, weight int")
    # One row per distinct (host, path), so a hot URL meets the rules once.
    distinct = urls.select(F.col(host).alias("h_"), F.col(path).alias("p_")).distinct()
    labels = F.split("h_", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        distinct.withColumn("rule_host", F.explode(suffixes))
        .join(table, "rule_host")
        .where(F.expr("startswith(p_, prefix)"))
        .groupBy("h_", "p_")
        .agg(F.min_by(F.struct("rule", "rule_action"), F.struct(-F.col("weight"), "rule")).alias("best"))
        .select("h_", "p_", "best.*")
    )
    return urls.join(best, (F.col(host) == F.col("h_")) & (F.col(path) == F.col("p_")), "left").drop("h_", "p_")


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` resource pairs from canonical links and meta refreshes in the HTML; relative targets are resolved.

    Each step names its input many times, so the steps are stored one after the other: merged into one expression
    they would grow with the product of these numbers.
    """
    ws = Workspace(pages.sparkSession, "page-edges")
    link = F.regexp_extract(html, r"(?i)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    refresh = F.regexp_extract(
        html, r"(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*([^\"'\s>]+)", 1
    )
    found = pages.select(F.col(url).alias("url"), F.array(link, refresh).alias("to")).select("url", F.explode("to").alias("to"))
    found = found.where("to <> '' and url is not null").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    base = F.regexp_extract("url", r"^([^?#]*/)", 1)
    origin = F.concat(F.substring_index("url", "://", 1), F.lit("://"), F.regexp_extract(_rest(F.col("url")), r"^([^/?#]*)", 1))
    target = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.substring_index("url", "://", 1), F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(origin, F.col("to")))
        .otherwise(F.concat(base, F.col("to")))
    )
    resolved = ws.table(found.select("url", target.alias("to")), "resolved")
    clean = ws.table(resolved.select("url", _without_dots(F.col("to")).alias("to")).distinct(), "clean")
    edges = ws.table(clean.select(url_node(F.col("url")).alias("src"), url_node(F.col("to")).alias("dst")), "edges")
    return edges.where("src is not null and dst is not null and src <> dst").distinct()


def _without_dots(url: Column) -> Column:
    """The URL with the steps ``.`` and ``..`` of its path taken."""
    path = url_path(url)
    steps = F.split(path, "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(step == ".", done).otherwise(F.array_append(done, step)),
    )
    clean = F.concat(F.array_join(walked, "/"), F.when(F.element_at(steps, -1).isin(".", ".."), "/").otherwise(""))
    before = F.regexp_extract(url, r"^([^?#]*?://[^/?#]*)", 1)
    after = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    return F.when(F.regexp_like(path, F.lit(r"/\.\.?(/|$)")), F.concat(before, clean, after)).otherwise(url)


def alias_edges(urls: DataFrame, url: str = "url") -> DataFrame:
    """``(src, dst)`` from web addresses to the form their sites redirect to.

    That form has the scheme https, no ``www.`` or ``m.`` in front of the host, no slash at the end
    of the path and no ``utm_`` parameters. Null, other schemes and addresses in that form give no edge.
    """
    src = url_node(F.col(url))
    host = F.regexp_replace(url_host(F.col(url)), r"^(www|m)\.", "")
    path = F.regexp_replace(url_path(F.col(url)), "/$", "")
    query = F.regexp_extract(_rest(F.col(url)), r"^[^?#]*\?([^#]*)", 1)
    params = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    target = F.concat(F.lit("https://"), host, F.when(path == "", "/").otherwise(path), F.when(params == "", "").otherwise(F.concat(F.lit("?"), params)))
    edges = Workspace(urls.sparkSession, "alias-edges").table(urls.where(F.col(url).isNotNull()).distinct().select(src.alias("src"), target.alias("dst")), "edges")
    return edges.where(F.regexp_like("src", F.lit("^https?://")) & (F.col("src") != F.col("dst"))).distinct()


def equivalence_edges(pages: DataFrame, url: str = "url", html: str = "html", redirects: DataFrame | None = None, aliases: bool = True) -> DataFrame:
    """Links found in the pages, observed ``redirects`` ``(from_url, to_url)`` if given, and, with ``aliases``, the alias edges of all of them."""
    linked = page_edges(pages, url, html)
    if redirects is not None:
        seen = redirects.select(url_node(F.col("from_url")).alias("src"), url_node(F.col("to_url")).alias("dst"))
        linked = linked.union(seen.where("src is not null and dst is not null and src <> dst"))
    known = pages.select(F.col(url).alias("url")).union(linked.select("dst"))
    return linked.union(alias_edges(known)) if aliases else linked


def judge_urls(
    urls: DataFrame,
    edges: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    default: str = "allow",
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``inherited`` to ``urls``; other columns stay.

    The verdict is the URL's own rule; else ``allow`` if an equivalent URL is explicitly allowed,
    else ``block`` if one is blocked, else ``default``. ``inherited`` tells that it came from
    equivalent URLs. Repeated URLs are judged alike; a null URL or one without ``://`` has empty
    host and path, no rule, and the default. Columns of the input named like the added ones are
    replaced. An empty edge table leaves rules and default.
    """
    added = ["host", "path", "rule", "rule_action", "node_", "inherited_", "verdict", "inherited"]
    kept = [c for c in urls.columns if c == url or c not in added]
    out = urls.select(*kept).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), "node_": url_node(F.col(url))})
    out = match_rules(out, rules)

    groups = connected_components(edges)
    judged = match_rules(groups.withColumns({"host": url_host(F.col("node")), "path": url_path(F.col("node"))}), rules)
    decided = judged.groupBy("component").agg(
        F.max((F.col("rule_action") == "allow").cast("int")).alias("allowed"),
        F.max((F.col("rule_action") == "block").cast("int")).alias("blocked"),
    )
    spread = decided.select("component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("inherited_"))
    by_node = groups.join(spread.where("inherited_ is not null"), "component").select(F.col("node").alias("node_"), "inherited_")
    out = out.join(by_node, "node_", "left").withColumns(
        {
            "verdict": F.coalesce("rule_action", "inherited_", F.lit(default)),
            "inherited": F.col("rule_action").isNull() & F.col("inherited_").isNotNull(),
        }
    )
    return out.select(*kept, "host", "path", "rule", "verdict", "inherited")
