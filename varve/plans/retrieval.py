"""Evidence cards, term weights, search and the question templates over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.columns import n_rows
from varve.operators.graphs import degrees
from varve.operators.products import top_products
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import Domain

W = Window.partitionBy
# English function words that carry no content.
STOP_WORDS = (
    "about above after again against all almost alone along already also although always am among an and another any anyone anything are around as at "
    "back be because been before behind being below between beyond both but by can cannot could did do does doing done down during each either else enough "
    "etc even ever every everyone everything few for from further had has have having he hence her here hers herself him himself his how however if in indeed "
    "into is it its itself just last least less many may me might mine more most much must my myself namely neither never nevertheless next no nobody none nor "
    "not nothing now of off often on once one only onto or other others otherwise our ours ourselves out over own per perhaps please rather same several she "
    "should since so some someone something sometimes still such than that the their theirs them themselves then there therefore these they this those though "
    "through thus to together too toward towards under until up upon us very via was we well were what whatever when whence where whether which while who whole "
    "whom whose why will with within without would yet you your yours yourself yourselves"
).split()
#: Letters, marks, digits and ``_`` of any script, two or more.
WORD = r"[\p{L}\p{M}\p{N}_]{2,}"
_STOPS = ",".join(f"'{w}'" for w in STOP_WORDS)


def terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, term, tf)``: words of two or more word characters and their pairs, lower-cased, without stop words."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda w: ~w.isin(STOP_WORDS))
    d = docs.select(key, words.alias("w"))
    pairs = F.transform(F.zip_with("w", F.slice("w", F.lit(2), F.size("w")), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))), lambda x: x)
    both = F.concat("w", F.filter(pairs, lambda x: x.isNotNull()))
    return d.select(key, F.explode(both).alias("term")).groupBy(key, "term").agg(n_rows().alias("tf"))


def tf_idf(docs: DataFrame, key: str, text: str, ws: Workspace | None = None) -> DataFrame:
    """``(key, term, weight)``: tf * (ln((1+n)/(1+df)) + 1), each document scaled to length 1.

    With ``ws`` the counted rows are stored by term, where they are small, so that their shuffle is gone before they move by document.
    """
    # By document first, so that counting its terms moves no term; the documents of a term are counted where its rows meet anyway.
    t = terms(docs.select(key, text).repartition(F.col(key)), key, text)
    n = docs.agg(n_rows().alias("n"))
    raw = t.withColumn("df", n_rows().over(W("term")))
    if ws is not None:
        raw = ws.table(raw, "counted", "zstd")
    raw = raw.crossJoin(F.broadcast(n))
    raw = raw.select(key, "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("x"))
    return raw.select(key, "term", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(W(key)))).alias("weight"))


def term_vectors(docs: DataFrame, key: str, text: str, asked: Column) -> DataFrame:
    """``(key, ids, weights)``: the weights of ``tf_idf`` of every document for the terms that some document with ``asked`` has.

    The other terms of a document count in its length. Of terms with the same hash the first keeps it as its id, the others have one of their own.
    """
    h = F.xxhash64("term")
    # Dealt by the hash, which is not moved itself; that serves both windows.
    t = terms(docs.select(key, text).repartition(F.col(key)), key, text).repartition(h).withColumn("h", h)
    t = t.withColumn("rank", F.dense_rank().over(W("h").orderBy("term")))
    same = W("h", "term")
    t = t.withColumns({"df": n_rows().over(same), "wanted": F.max(F.coalesce(asked, F.lit(False))).over(same)})
    t = t.select(key, F.when(F.col("rank") == 1, F.col("h")).otherwise(F.xxhash64("term", "rank")).alias("id"), "tf", "df", "wanted")
    t = t.crossJoin(F.broadcast(docs.agg(n_rows().alias("n"))))
    x = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    # What is not wanted is summed before it is moved.
    v = t.groupBy(key).agg(F.sqrt(F.sum(x * x)).alias("length"), F.collect_list(F.when(F.col("wanted"), F.struct("id", x.alias("x")))).alias("v"))
    return v.where(F.size("v") > 0).select(key, F.col("v.id").alias("ids"), F.transform("v", lambda p: p["x"] / F.col("length")).alias("weights"))


def search(index: DataFrame, wanted: DataFrame, key: str, k: int, query_key: str = "query_id") -> DataFrame:
    """``(query_id, key, score)``: the k best documents by dot product with each query vector ``(query_id, term, weight)``, ties by key."""
    q = wanted.select(query_key, "term", F.col("weight").alias("q"))
    scored = index.join(q, "term").groupBy(query_key, key).agg(F.round(F.sum(F.col("weight") * F.col("q")), 6).alias("score"))
    r = F.row_number().over(W(query_key).orderBy(F.desc("score"), key))
    return scored.withColumn("r", r).where(F.col("r") <= k).drop("r")


_TFIDF = f""", tokens AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text),'{WORD}'), lambda w: w NOT IN ({_STOPS})) AS w FROM documents),
grams AS (SELECT doc_id, unnest(w) AS term FROM tokens UNION ALL SELECT doc_id, unnest(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) FROM tokens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT doc_id, term, tf*(ln((1+(SELECT count(*) FROM documents))/(1.0+df))+1) AS x FROM tf JOIN df USING (term)),
tfidf AS (SELECT doc_id, term, x/sqrt(sum(x*x) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


@query("q02_tf_idf", _TFIDF + " SELECT doc_id, term, round(weight,6) AS weight FROM tfidf")
def tf_idf_weights(d: Domain):
    return tf_idf(d.table("documents"), "doc_id", "text", Workspace(d.spark, "weights")).withColumn("weight", F.round("weight", 6))


@query(
    "q03_semantic_search",
    _TFIDF
    + """ , s AS (SELECT q.doc_id AS query_id, i.doc_id AS doc_id, round(sum(i.weight*q.weight),6) AS score FROM tfidf i JOIN tfidf q USING (term) WHERE q.doc_id%20=0 GROUP BY ALL)
    SELECT query_id, doc_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)<=10""",
)
def semantic_search(d: Domain):
    """Every document whose id is divisible by 20 against all documents."""
    wanted = F.col("doc_id") % 20 == 0
    index = Workspace(d.spark, "search").table(term_vectors(d.table("documents"), "doc_id", "text", wanted), "index")
    return top_products(index, index.where(wanted).withColumnRenamed("doc_id", "query_id"), 10, "doc_id")


@query(
    "q05_evidence_cards",
    """SELECT 'sample:'||label AS card_id, 'sample' AS card_type, label::VARCHAR AS entity_id, 'Sample '||label||' of '||core AS title, core AS core FROM meta
    UNION ALL SELECT 'site:'||core, 'site', core, 'Site '||core||' with '||count(*)||' samples', core FROM meta GROUP BY core
    UNION ALL SELECT 'taxon:'||regexp_replace(regexp_replace(taxon,'[^A-Za-z0-9]+','_','g'),'^_|_$','','g'), 'taxon', taxon, 'Taxon '||taxon||' in '||n_samples||' samples', NULL FROM prevalent WHERE threshold=5""",
)
def evidence_cards(d: Domain) -> DataFrame:
    from varve.functions.columns import slugify

    s = F.col("label").cast("string")
    sample = d.meta.select(F.concat(F.lit("sample:"), s).alias("card_id"), F.lit("sample").alias("card_type"), s.alias("entity_id"), F.concat(F.lit("Sample "), s, F.lit(" of "), "core").alias("title"), "core")
    site = d.meta.groupBy("core").agg(n_rows().alias("n")).select(
        F.concat(F.lit("site:"), "core").alias("card_id"), F.lit("site").alias("card_type"), F.col("core").alias("entity_id"), F.format_string("Site %s with %d samples", "core", "n").alias("title"), "core"
    )
    taxon = d.prevalent.where("threshold = 5").select(
        F.concat(F.lit("taxon:"), slugify(F.col("taxon"))).alias("card_id"), F.lit("taxon").alias("card_type"), F.col("taxon").alias("entity_id"),
        F.format_string("Taxon %s in %d samples", "taxon", "n_samples").alias("title"), F.lit(None).cast("string").alias("core"),
    )
    return reduce(DataFrame.unionByName, [sample, site, taxon])


@query(
    "q06_transition",
    """, cut AS (SELECT median(mis) AS m FROM meta), bins AS (SELECT taxon, coalesce(avg(abundance) FILTER (WHERE mis<=m),0) AS low, coalesce(avg(abundance) FILTER (WHERE mis>m),0) AS high FROM clr5, cut GROUP BY taxon)
    SELECT taxon, round(low,6) AS low, round(high,6) AS high, round(high-low,6) AS delta FROM bins ORDER BY round(abs(high-low),6) DESC, taxon LIMIT 20""",
)
def transition(d: Domain):
    cut = d.meta.agg(F.median("mis").alias("m"))
    x = d.clr_primary.crossJoin(F.broadcast(cut))
    mean = lambda c: F.coalesce(F.avg(F.when(c, F.col("abundance"))), F.lit(0.0))
    g = x.groupBy("taxon").agg(mean(F.col("mis") <= F.col("m")).alias("a"), mean(F.col("mis") > F.col("m")).alias("b"))
    out = g.select("taxon", F.round("a", 6).alias("low"), F.round("b", 6).alias("high"), F.round(F.col("b") - F.col("a"), 6).alias("delta"), F.round(F.abs(F.col("b") - F.col("a")), 6).alias("size"))
    return out.orderBy(F.desc("size"), "taxon").limit(20).drop("size")


@query(
    "q07_seeding",
    """, x AS (SELECT taxon, avg(abundance) AS mean_abundance, count(*) FILTER (WHERE abundance>0) AS present FROM clr5 WHERE core='ASIA' GROUP BY taxon),
    y AS (SELECT x.*, coalesce(degree,0) AS degree FROM x LEFT JOIN (SELECT * FROM degrees WHERE core='ASIA') USING (taxon)),
    e AS (SELECT min(mean_abundance) a0, max(mean_abundance) a1, min(present) p0, max(present) p1, min(degree) d0, max(degree) d1 FROM y)
    SELECT taxon, present, degree, round(0.6*coalesce((mean_abundance-a0)/nullif(a1-a0,0),0)+0.2*coalesce((present-p0)*1.0/nullif(p1-p0,0),0)+0.2*coalesce((degree-d0)*1.0/nullif(d1-d0,0),0),6) AS score FROM y, e""",
)
def seeding(d: Domain):
    x = d.clr_primary.where("core = 'ASIA'").groupBy("taxon").agg(F.avg("abundance").alias("mean_abundance"), F.count_if(F.col("abundance") > 0).alias("present"))
    k = degrees(d.edges).where("core = 'ASIA'").select("taxon", "degree")
    y = x.join(k, "taxon", "left").fillna(0, ["degree"])
    weights = {"mean_abundance": 0.6, "present": 0.2, "degree": 0.2}
    ends = y.agg(*[f(c).alias(f"{c}_{n}") for c in weights for n, f in (("lo", F.min), ("hi", F.max))])
    y = y.crossJoin(F.broadcast(ends))
    parts = [w * F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_lo"), (F.col(f"{c}_hi") - F.col(f"{c}_lo")).cast("double")), F.lit(0.0)) for c, w in weights.items()]
    return y.select("taxon", "present", "degree", F.round(reduce(lambda a, b: a + b, parts), 6).alias("score"))


@query(
    "q15_summary",
    "SELECT 'sample' AS card_type, count(*) AS n FROM meta UNION ALL SELECT 'site', count(DISTINCT core) FROM meta UNION ALL SELECT 'taxon', count(*) FROM prevalent WHERE threshold=5",
)
def card_summary(d: Domain):
    return evidence_cards(d).groupBy("card_type").agg(n_rows().alias("n"))


@query("q18_links_browse", "SELECT core, src, dst, round(weight,6) AS weight FROM edges ORDER BY round(weight,6) DESC, core, src, dst LIMIT 25")
def links_browse(d: Domain):
    return d.edges.select("core", "src", "dst", F.round("weight", 6).alias("weight")).orderBy(F.desc("weight"), "core", "src", "dst").limit(25)


@query("m15_fingerprint", "SELECT label%3 AS state, core, count(*) AS n, round(avg(sst),6) AS mean_sst, round(avg((mis>4)::INT),6) AS glacial FROM meta GROUP BY ALL")
def fingerprint(d: Domain):
    g = d.meta.groupBy((F.col("label") % 3).alias("state"), "core")
    return g.agg(n_rows().alias("n"), F.round(F.avg("sst"), 6).alias("mean_sst"), F.round(F.avg((F.col("mis") > 4).cast("int")), 6).alias("glacial"))
