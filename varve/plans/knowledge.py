"""Signature comparison, knowledge cards, browsing, decision tables and round trips of the sinks."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.functions.columns import n_rows
from varve.operators import graphs
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.plans.retrieval import evidence_cards
from varve.sources import tables
from varve.sources.domain import PRIMARY, Domain

W = Window.partitionBy


# Round trips of sources and sinks


@query("s01_tsv_scan", "SELECT s_suppkey, s_acctbal FROM supplier")
def tsv_scan(d: Domain):
    """A gzipped TSV with a header, of which two columns are read."""
    path = Workspace(d.spark, "tsv").path("supplier")
    rows = d.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    rows.write.options(sep="\t", header=True, nullValue="NA", compression="gzip").csv(path)
    return tables.read_tsv(d.spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), ["s_suppkey", "s_acctbal"])


_CARDS = """, cards AS (SELECT 'sample:'||label AS card_id, 'sample' AS card_type, label::VARCHAR AS entity_id, 'Sample '||label||' of '||core AS title, core AS core FROM meta
    UNION ALL SELECT 'site:'||core, 'site', core, 'Site '||core||' with '||count(*)||' samples', core FROM meta GROUP BY core
    UNION ALL SELECT 'taxon:'||regexp_replace(regexp_replace(taxon,'[^A-Za-z0-9]+','_','g'),'^_|_$','','g'), 'taxon', taxon, 'Taxon '||taxon||' in '||n_samples||' samples', NULL FROM prevalent WHERE threshold=5)"""


@query("s08_jsonl_cards", _CARDS + " SELECT * FROM cards")
def jsonl_cards(d: Domain):
    """Cards written as one JSON object per line and read again."""
    cards = evidence_cards(d)
    path = Workspace(d.spark, "jsonl").path("cards")
    cards.write.json(path)
    return d.spark.read.schema(cards.schema).json(path)


@query("s14_branches", "SELECT threshold::INT AS threshold, taxon, n_samples FROM prevalent WHERE threshold=5")
def branches(d: Domain):
    """One folder per threshold; only the wanted one is read."""
    path = Workspace(d.spark, "branches").path("prevalent")
    d.prevalent.write.partitionBy("threshold").parquet(path)
    return d.spark.read.parquet(path).where(F.col("threshold") == PRIMARY).select("threshold", "taxon", "n_samples")


@query("s15_progress_log", "SELECT r_regionkey AS step, r_name AS message FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def progress_log(d: Domain):
    """A log table to which two steps append."""
    path = Workspace(d.spark, "log").path("progress")
    for rows in (d.table("region").select("r_regionkey", "r_name"), d.table("nation").select("n_nationkey", "n_name")):
        rows.toDF("step", "message").write.mode("append").parquet(path)
    return d.spark.read.parquet(path)


@query(
    "c10_artifact_checklist",
    "SELECT * FROM (VALUES ('documents','ready'),('embeddings','ready'),('forecasts','missing: build it first'),('lineitem','ready'),('orders','ready')) t(artifact, note)",
)
def artifact_checklist(d: Domain):
    """Which expected artifacts exist; the inventory lists files without reading them."""
    wanted = d.spark.createDataFrame([("documents",), ("embeddings",), ("forecasts",), ("lineitem",), ("orders",)], "artifact string")
    files = d.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(d.sf_dir)
    found = files.select(F.regexp_extract("path", r"([^/]+)\.parquet(/|$)", 1).alias("artifact")).distinct().withColumn("found", F.lit(True))
    note = F.when(F.col("found"), "ready").otherwise("missing: build it first")
    return wanted.join(found, "artifact", "left").select("artifact", note.alias("note"))


# Text functions


def core_in_text(text: Column, cores: Column) -> Column:
    """The core a question names: the longest that is part of it, else the first that ends in R1 or R2 if it says so, else null.

    ``cores`` is an array ordered by falling length.
    """
    q = F.lower(text)
    ending = lambda r: F.filter(cores, lambda c: c.endswith(r))
    named = F.filter(cores, lambda c: F.contains(q, F.lower(c)))
    first = lambda found: F.get(found, F.lit(0))
    return F.coalesce(first(named), F.when(F.contains(q, F.lit("r1")), first(ending("R1"))), F.when(F.contains(q, F.lit("r2")), first(ending("R2"))))


_QUESTION = "CASE label%4 WHEN 0 THEN 'Taxa of '||lower(core)||'_r1 at depth' WHEN 1 THEN 'which are in core R2' WHEN 2 THEN 'R1 overview' ELSE 'nothing named' END"


@query(
    "f04_core_names",
    f""", names AS (SELECT list(c ORDER BY length(c) DESC, c) AS cores FROM (SELECT DISTINCT core||'_R'||(label%2+1) AS c FROM meta)),
    asked AS (SELECT label, lower({_QUESTION}) AS q FROM meta)
    SELECT label, coalesce(list_filter(cores, lambda c: contains(q,lower(c)))[1], CASE WHEN contains(q,'r1') THEN list_filter(cores, lambda c: ends_with(c,'R1'))[1] END,
      CASE WHEN contains(q,'r2') THEN list_filter(cores, lambda c: ends_with(c,'R2'))[1] END) AS core FROM asked, names""",
)
def core_names(d: Domain):
    name = F.concat("core", F.lit("_R"), (F.col("label") % 2 + 1).cast("string"))
    # One row: the names of the cores, a few.
    ordered = F.transform(F.array_sort(F.collect_set(F.struct((-F.length(name)).alias("n"), name.alias("c")))), lambda x: x["c"])
    names = d.meta.agg(ordered.alias("cores"))
    k = F.col("label") % 4
    text = F.when(k == 0, F.concat(F.lit("Taxa of "), F.lower("core"), F.lit("_r1 at depth"))).when(k == 1, "which are in core R2").when(k == 2, "R1 overview").otherwise("nothing named")
    return d.meta.withColumn("q", text).crossJoin(F.broadcast(names)).select("label", core_in_text(F.col("q"), F.col("cores")).alias("core"))


# Signatures


@query(
    "f18_signature_distance",
    """, sig AS (SELECT core, functional_group AS g, avg(abundance) AS x FROM clr5 JOIN taxa USING (taxon) GROUP BY ALL),
    pairs AS (SELECT a.core AS core_a, b.core AS core_b, sqrt(sum((a.x-b.x)*(a.x-b.x))) AS dist FROM sig a JOIN sig b ON a.g=b.g AND a.core<b.core GROUP BY ALL)
    SELECT core_a, core_b, round(dist,6) AS distance, round(1/(1+dist),6) AS similarity FROM pairs""",
)
def signature_distance(d: Domain):
    """Euclidean distance between the functional profiles of two cores; every core has every group of the primary taxa."""
    x = d.clr_primary.join(d.taxa, "taxon").groupBy("core", "functional_group").agg(F.avg("abundance").alias("x"))
    profile = x.groupBy("core").agg(F.transform(F.array_sort(F.collect_list(F.struct("functional_group", "x"))), lambda s: s["x"]).alias("v"))
    a, b = profile.toDF("core_a", "va"), profile.toDF("core_b", "vb")
    pairs = a.join(b, F.col("core_a") < F.col("core_b")).withColumn("d", C.euclidean("va", "vb"))
    return pairs.select("core_a", "core_b", F.round("d", 6).alias("distance"), F.round(1 / (1 + F.col("d")), 6).alias("similarity"))


@query("g07_super_graph")
def super_graph(d: Domain):
    """Core pairs weighted by the mean of edge Jaccard and spectral similarity, whichever exist."""
    vertices = d.clr_primary.select("core", "taxon").distinct()
    edges = Workspace(d.spark, "super").table(d.edges, "edges")
    sig = graphs.spectral_signatures(edges, vertices)
    a, b = sig.toDF("core_a", "va"), sig.toDF("core_b", "vb")
    spectral = a.join(b, F.col("core_a") < F.col("core_b")).select("core_a", "core_b", (1 / (1 + C.euclidean("va", "vb"))).alias("spectral_similarity"))
    out = spectral.join(graphs.edge_jaccard(edges), ["core_a", "core_b"], "left")
    return out.select("core_a", "core_b", "edge_jaccard", "spectral_similarity", C.row_mean("edge_jaccard", "spectral_similarity").alias("super_weight"))


@query(
    "g28_module_star",
    "SELECT functional_group AS module, taxon, round(avg(abundance),6) AS weight FROM clr5 JOIN taxa USING (taxon) GROUP BY ALL",
)
def module_star(d: Domain):
    return d.clr_primary.join(d.taxa, "taxon").groupBy(F.col("functional_group").alias("module"), "taxon").agg(F.round(F.avg("abundance"), 6).alias("weight"))


@query(
    "m01_padded_features",
    """SELECT 'sample:'||label AS node, [round(age_kyr,6), round(mis,6), round(sst,6), 0.0::DOUBLE] AS features FROM meta
    UNION ALL SELECT 'taxon:'||taxon, [round(avg(clr),6), round(stddev_samp(clr),6), round(avg((abundance>0)::INT),6), round(avg(abundance),6)] FROM clr5 GROUP BY taxon""",
)
def padded_features(d: Domain):
    """Samples and taxa as vectors of the width of the wider kind, filled with zeros."""
    r = lambda c: C.rounded(F.col(c) if isinstance(c, str) else c, 6)
    sample = d.meta.select(F.concat(F.lit("sample:"), F.col("label").cast("string")).alias("node"), F.array(r("age_kyr"), r("mis"), r("sst")).alias("features"))
    taxon = d.clr_primary.groupBy("taxon").agg(
        F.array(r(F.avg("clr")), r(F.stddev_samp("clr")), r(F.avg((F.col("abundance") > 0).cast("int"))), r(F.avg("abundance"))).alias("features")
    )
    both = sample.unionByName(taxon.select(F.concat(F.lit("taxon:"), "taxon").alias("node"), "features"))
    return both.withColumn("features", F.concat("features", F.array_repeat(F.lit(0.0), 4 - F.size("features"))))


@query(
    "m08_pooling_sizes",
    """, n AS (SELECT threshold, count(*) AS n FROM prevalent GROUP BY ALL), a AS (SELECT threshold, n, greatest(4,least(32,round_even(sqrt(n),0)))::BIGINT AS first_level FROM n)
    SELECT threshold, n, first_level, greatest(2,first_level//2)::BIGINT AS second_level FROM a""",
)
def pooling_sizes(d: Domain):
    n = d.prevalent.groupBy("threshold").agg(n_rows().alias("n"))
    n = n.withColumn("first_level", F.greatest(F.lit(4), F.least(F.lit(32), F.bround(F.sqrt("n")).cast("long"))).cast("long"))
    return n.withColumn("second_level", F.greatest(F.lit(2), F.floor(F.col("first_level") / 2)).cast("long"))


@query(
    "m11_imputed",
    """, f AS (SELECT label, CASE WHEN label%7=0 THEN NULL ELSE sst END AS sst, CASE WHEN label%5=0 THEN NULL ELSE mis END AS mis FROM meta),
    m AS (SELECT (sum(coalesce(sst,0))+sum(coalesce(mis,0)))/(count(sst)+count(mis)) AS m FROM f)
    SELECT label, round(coalesce(sst,m),6) AS sst, round(coalesce(mis,m),6) AS mis FROM f, m""",
)
def imputed(d: Domain):
    """Missing features become the mean of all finite values of the whole matrix, whatever their column."""
    f = d.meta.select("label", F.when(F.col("label") % 7 != 0, F.col("sst")).alias("sst"), F.when(F.col("label") % 5 != 0, F.col("mis")).alias("mis"))
    names = ["sst", "mis"]
    total = reduce(lambda a, b: a + b, [F.coalesce(F.sum(c), F.lit(0.0)) for c in names])
    mean = f.agg(F.try_divide(total, reduce(lambda a, b: a + b, [F.count(c) for c in names])).alias("m"))
    return f.crossJoin(F.broadcast(mean)).select("label", *[F.round(F.coalesce(c, "m"), 6).alias(c) for c in names])


def state_importance(membership: DataFrame, fingerprint: DataFrame) -> DataFrame:
    """``(taxon, state, importance)``: sum over modules of membership times the module's mean in the state."""
    both = membership.select("taxon", "module", "kme").join(fingerprint.select("module", "state", "mean"), "module")
    return both.groupBy("taxon", "state").agg(F.sum(F.col("kme") * F.col("mean")).alias("importance"))


_PROFILE = """, profile AS (SELECT functional_group AS module, label, avg(clr) AS p FROM clr5 JOIN taxa USING (taxon) GROUP BY ALL),
    kme AS (SELECT c.taxon, p.module, CASE WHEN stddev_pop(c.clr)>1e-12 AND stddev_pop(p.p)>1e-12 THEN corr(c.clr,p.p) END AS kme FROM clr5 c JOIN profile p USING (label) GROUP BY ALL)"""


def module_profiles(d: Domain) -> DataFrame:
    return d.clr_primary.join(d.taxa, "taxon").groupBy(F.col("functional_group").alias("module"), "label").agg(F.avg("clr").alias("p"))


def memberships(d: Domain) -> DataFrame:
    """Correlation of every taxon with every module's mean profile (modules are few, the product is taxa x modules)."""
    both = d.clr_primary.select("taxon", "label", "clr").join(module_profiles(d), "label").groupBy("taxon", "module")
    usable = (F.stddev_pop("clr") > 1e-12) & (F.stddev_pop("p") > 1e-12)
    return both.agg(F.when(usable, F.corr("clr", "p")).alias("kme"))


@query("g15_module_membership", _PROFILE + " SELECT taxon, module, round(kme,6) AS kme FROM kme")
def module_membership(d: Domain):
    return memberships(d).withColumn("kme", F.round("kme", 6))


@query(
    "m16_state_importance",
    _PROFILE + """, finger AS (SELECT module, CASE WHEN mis>4 THEN 'glacial' ELSE 'warm' END AS state, avg(p) AS mean FROM profile JOIN meta USING (label) GROUP BY ALL)
    SELECT taxon, state, round(sum(kme*mean),6) AS importance FROM kme JOIN finger USING (module) GROUP BY ALL""",
)
def state_importances(d: Domain):
    state = F.when(F.col("mis") > 4, "glacial").otherwise("warm")
    finger = module_profiles(d).join(d.meta.select("label", state.alias("state")), "label").groupBy("module", "state").agg(F.avg("p").alias("mean"))
    return state_importance(memberships(d), finger).withColumn("importance", F.round("importance", 6))


@query(
    "m18_site_summary",
    """, present AS (SELECT core, count(DISTINCT taxon) FILTER (WHERE abundance>0) AS present_taxa FROM clr5 GROUP BY core), cores AS (SELECT DISTINCT core FROM clr5),
    m AS (SELECT core, count(*) AS m FROM edges GROUP BY core),
    sim AS (SELECT a.core AS ca, b.core AS cb, count(*) AS shared FROM edges a JOIN edges b ON a.src=b.src AND a.dst=b.dst AND a.core<>b.core GROUP BY ALL),
    grid AS (SELECT a.core, coalesce(s.shared*1.0/(ma.m+mb.m-s.shared),0) AS w FROM cores a JOIN cores b ON a.core<>b.core LEFT JOIN sim s ON s.ca=a.core AND s.cb=b.core
      LEFT JOIN m ma ON ma.core=a.core LEFT JOIN m mb ON mb.core=b.core)
    SELECT core, present_taxa, round(mean_similarity,6) AS mean_similarity FROM present JOIN (SELECT core, avg(w) AS mean_similarity FROM grid GROUP BY core) USING (core)""",
)
def site_summary(d: Domain):
    """Present taxa of every core and its mean edge similarity to the other cores; a missing pair counts as 0."""
    x = d.clr_primary
    present = x.groupBy("core").agg(F.countDistinct(F.when(F.col("abundance") > 0, F.col("taxon"))).alias("present_taxa"))
    sim = graphs.edge_jaccard(Workspace(d.spark, "sites").table(d.edges, "edges")).select("core_a", "core_b", F.coalesce("edge_jaccard", F.lit(0.0)).alias("w"))
    both = sim.select(F.col("core_a").alias("core"), "w").union(sim.select("core_b", "w")).groupBy("core").agg(F.sum("w").alias("total"))
    others = present.agg((n_rows() - 1).alias("others"))
    out = present.join(both, "core", "left").crossJoin(F.broadcast(others))
    return out.select("core", "present_taxa", F.round(F.try_divide(F.coalesce("total", F.lit(0.0)), F.col("others")), 6).alias("mean_similarity"))


# Cards and neighbours


@query(
    "q01_card_text",
    _CARDS + " SELECT card_id, concat_ws(' ',nullif(trim(card_type),''),nullif(trim(entity_id),''),nullif(trim(title),''),nullif(trim(core),'')) AS text FROM cards",
)
def card_text(d: Domain):
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return evidence_cards(d).select("card_id", F.concat_ws(" ", part("card_type"), part("entity_id"), part("title"), part("core")).alias("text"))


@query(
    "q16_card_browse",
    _CARDS + " SELECT card_id, card_type, title FROM cards WHERE card_type IN ('site','taxon') AND contains(lower(coalesce(title,'')||' '||coalesce(entity_id,'')),'steel') ORDER BY card_id LIMIT 25",
)
def card_browse(d: Domain):
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("entity_id", F.lit(""))))
    cards = evidence_cards(d).where(F.col("card_type").isin("site", "taxon") & F.contains(text, F.lit("steel")))
    return cards.select("card_id", "card_type", "title").orderBy("card_id").limit(25)


@query(
    "q17_module_summary",
    """, member AS (SELECT DISTINCT taxon, functional_group AS module, phylum FROM clr5 JOIN taxa USING (taxon)),
    c AS (SELECT module, phylum, count(*) AS n FROM member GROUP BY ALL), top AS (SELECT module, phylum, row_number() OVER (PARTITION BY module ORDER BY n DESC, phylum) AS r FROM c)
    SELECT m.module, count(*) AS taxa, any_value(t.phylum) AS top_phylum, round(avg(coalesce(k.degree,0)),6) AS mean_degree FROM member m
    JOIN top t ON t.module=m.module AND t.r=1 LEFT JOIN (SELECT taxon, sum(degree) AS degree FROM degrees GROUP BY taxon) k ON k.taxon=m.taxon GROUP BY m.module""",
)
def module_summary(d: Domain):
    member = d.clr_primary.select("taxon").distinct().join(d.taxa.withColumnRenamed("functional_group", "module"), "taxon")
    order = W("module").orderBy(F.desc("n"), "phylum")
    top = member.groupBy("module", "phylum").agg(n_rows().alias("n")).withColumn("r", F.row_number().over(order)).where("r = 1")
    degree = graphs.degrees(d.edges).groupBy("taxon").agg(F.sum("degree").alias("degree"))
    means = member.join(degree, "taxon", "left").groupBy("module").agg(n_rows().alias("taxa"), F.round(F.avg(F.coalesce("degree", F.lit(0))), 6).alias("mean_degree"))
    return means.join(top.select("module", F.col("phylum").alias("top_phylum")), "module")


@query("q19_embedding_browse", "SELECT vec_id, round(embedding[1]::DOUBLE,6) AS x, round(embedding[2]::DOUBLE,6) AS y FROM embeddings ORDER BY vec_id LIMIT 800")
def embedding_browse(d: Domain):
    at = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return d.table("embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y")).orderBy("vec_id").limit(800)


def best_of_block(ids: np.ndarray, matrix: np.ndarray, asked: np.ndarray, wanted: np.ndarray, k: int, values: int = 1 << 22) -> pd.DataFrame:
    """The k best rows of a block for every query of another; at most ``values`` similarities are there at a time."""
    order = np.argsort(ids, kind="stable")
    ids, matrix = ids[order], matrix[order]
    step, out = max(values // max(len(ids), 1), 1), []
    for at in range(0, len(asked), step):
        found = np.round(wanted[at : at + step] @ matrix.T, 6)
        found[asked[at : at + step, None] == ids[None, :]] = -np.inf
        least = np.partition(found, -k, axis=1)[:, -k] if k < len(ids) else np.full(len(found), -np.inf)
        for q, s, low in zip(asked[at : at + step], found, least, strict=True):
            near = np.flatnonzero((s >= low) & (s > -np.inf))
            top = near[np.argsort(-s[near], kind="stable")[:k]]
            out.append((np.full(len(top), q), ids[top], s[top]))
    return pd.DataFrame({c: np.concatenate(part) for c, part in zip(("query_id", "neighbour_id", "similarity"), zip(*out), strict=True)})


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", block_rows: int = 20_000) -> DataFrame:
    """``(query_id, neighbour_id, similarity)``: the k rows of largest cosine similarity to each query, itself excluded, ties by id.

    Rows and queries are dealt into blocks; every block of queries meets every block of rows in
    matrix products of bounded size, and only k rows per query leave it. Null vectors take part in nothing; a zero
    vector has similarity 0.
    """
    usable = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    rows, asked = usable(vectors), usable(queries)
    blocks = lambda df: max(-(-df.count() // block_rows), 1)
    n_rows_, n_asked = blocks(rows), blocks(asked)
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.withColumn("rb", deal(n_rows_, 1)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("qb", deal(n_asked, 2)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_rows_ - 1))))

    def unit(column: pd.Series) -> np.ndarray:
        x = np.array(column.tolist(), dtype=np.float64)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "neighbour_id": [], "similarity": []})
        return best_of_block(a["id"].to_numpy(), unit(a["v"]), b["id"].to_numpy(), unit(b["v"]), k)

    met = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(best, "query_id long, neighbour_id long, similarity double")
    r = F.row_number().over(W("query_id").orderBy(F.desc("similarity"), "neighbour_id"))
    return met.withColumn("r", r).where(F.col("r") <= k).drop("r")


@query(
    "q04_nearest_neighbours",
    """, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x*x))),1e-12) AS len FROM v),
    s AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbour_id, round(list_dot_product(q.e,r.e)/(q.len*r.len),6) AS similarity FROM n q JOIN n r ON q.vec_id<>r.vec_id WHERE q.vec_id%20=0)
    SELECT query_id, neighbour_id, similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id)<=5""",
)
def nearest_neighbours(d: Domain):
    vectors = d.table("embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 5)


# Decision tables


@query(
    "c05_decision_matrix",
    """, s AS (SELECT threshold, count(DISTINCT taxon) AS taxa, avg((abundance=0)::INT) AS empty_share, median(abundance) AS middle FROM cells GROUP BY threshold),
    n AS (SELECT *, abs(taxa-50) AS off FROM s), e AS (SELECT *, CASE WHEN max(empty_share) OVER ()=min(empty_share) OVER () THEN 1.0 ELSE 1-(empty_share-min(empty_share) OVER ())/(max(empty_share) OVER ()-min(empty_share) OVER ()) END AS g,
      CASE WHEN max(off) OVER ()=min(off) OVER () THEN 1.0 ELSE 1-(off-min(off) OVER ())*1.0/(max(off) OVER ()-min(off) OVER ()) END AS c FROM n)
    SELECT threshold, taxa, round(0.6*g+0.4*c,6) AS score, row_number() OVER (ORDER BY round(0.6*g+0.4*c,6) DESC, threshold) AS rank FROM e""",
)
def decision_matrix(d: Domain):
    """Thresholds ranked by a weighted score of scaled criteria, lower being better; the table has a row per setting."""
    s = d.cells.groupBy("threshold").agg(F.countDistinct("taxon").alias("taxa"), F.avg((F.col("abundance") == 0).cast("int")).alias("empty_share"))
    s = s.withColumn("off", F.abs(F.col("taxa") - 50).cast("double"))
    everything = W(F.lit(0))

    def good(c: str) -> Column:
        low, high = F.min(c).over(everything), F.max(c).over(everything)
        return F.when(low == high, 1.0).otherwise(1 - (F.col(c) - low) / (high - low))

    s = s.withColumn("score", F.round(0.6 * good("empty_share") + 0.4 * good("off"), 6))
    return s.select("threshold", "taxa", "score", F.row_number().over(everything.orderBy(F.desc("score"), "threshold")).alias("rank"))


@query(
    "c06_age_bins",
    """, b AS (SELECT core, floor(age_kyr/25)*25 AS bin, count(*) AS n FROM meta GROUP BY ALL), t AS (SELECT core, sum(n) AS total FROM b GROUP BY core), k AS (SELECT bin, sum(n) AS in_bin FROM b GROUP BY bin), g AS (SELECT sum(n) AS n FROM b)
    SELECT b.core, b.bin, b.n, round(b.n*g.n*1.0/(t.total*k.in_bin),6) AS fairness, CASE WHEN b.bin<50 THEN 'young' WHEN b.bin<100 THEN 'focus' ELSE 'old' END AS band FROM b JOIN t USING (core) JOIN k USING (bin), g""",
)
def age_bins(d: Domain):
    """Observed over expected samples of every core and age bin, and the band of the bin."""
    b = d.meta.groupBy("core", (F.floor(F.col("age_kyr") / 25) * 25.0).alias("bin")).agg(n_rows().alias("n"))
    total, in_bin, g = b.groupBy("core").agg(F.sum("n").alias("total")), b.groupBy("bin").agg(F.sum("n").alias("in_bin")), b.agg(F.sum("n").alias("all"))
    x = b.join(total, "core").join(in_bin, "bin").crossJoin(F.broadcast(g))
    band = F.when(F.col("bin") < 50, "young").when(F.col("bin") < 100, "focus").otherwise("old")
    return x.select("core", "bin", "n", F.round(F.col("n") * F.col("all") / (F.col("total") * F.col("in_bin")), 6).alias("fairness"), band.alias("band"))


@query(
    "c07_driver_tiers",
    """, x AS (SELECT core, taxon, avg(abundance) AS importance FROM clr5 GROUP BY ALL), y AS (SELECT x.*, coalesce(degree,0) AS degree, round(coalesce(strength,0),6) AS strength FROM x LEFT JOIN degrees USING (core, taxon)),
    r AS (SELECT *, count(*) OVER c AS n, rank() OVER (PARTITION BY core ORDER BY importance)+(count(*) OVER (PARTITION BY core, importance)-1)/2.0 AS ri,
      rank() OVER (PARTITION BY core ORDER BY degree)+(count(*) OVER (PARTITION BY core, degree)-1)/2.0 AS rd, rank() OVER (PARTITION BY core ORDER BY strength)+(count(*) OVER (PARTITION BY core, strength)-1)/2.0 AS rs FROM y WINDOW c AS (PARTITION BY core)),
    p AS (SELECT core, taxon, round(ri/n,6) AS stat, round((rd+rs)/(2*n),6) AS topo, round((2*ri+rd+rs)/(4*n),6) AS score FROM r)
    SELECT core, taxon, stat, topo, score, CASE WHEN stat>=0.9 AND topo>=0.9 THEN 'super-driver' WHEN stat>=0.8 AND topo>=0.8 THEN 'high potential' WHEN stat>=0.9 THEN 'specialist' ELSE 'peripheral' END AS tier FROM p""",
)
def driver_tiers(d: Domain):
    """Percentiles of a statistical and of topological measures, their mean (rounded once, from the ranks), and the tier."""
    x = d.clr_primary.groupBy("core", "taxon").agg(F.avg("abundance").alias("importance"))
    y = x.join(graphs.degrees(d.edges), ["core", "taxon"], "left").fillna(0, ["degree"]).withColumn("strength", F.round(F.coalesce("strength", F.lit(0.0)), 6))
    rank = {c: C.average_rank(c, ["core"]) for c in ("importance", "degree", "strength")}
    n = F.count(F.lit(1)).over(W("core"))
    p = y.select("core", "taxon", F.round(rank["importance"] / n, 6).alias("stat"), F.round((rank["degree"] + rank["strength"]) / (2 * n), 6).alias("topo"), F.round((2 * rank["importance"] + rank["degree"] + rank["strength"]) / (4 * n), 6).alias("score"))
    s, t = F.col("stat"), F.col("topo")
    tier = F.when((s >= 0.9) & (t >= 0.9), "super-driver").when((s >= 0.8) & (t >= 0.8), "high potential").when(s >= 0.9, "specialist").otherwise("peripheral")
    return p.withColumn("tier", tier)


@query(
    "c08_functional_master",
    """, x AS (SELECT functional_group, CASE WHEN mis>4 THEN 'glacial' ELSE 'warm' END AS state, sum(abundance) AS amount FROM clr5 JOIN taxa USING (taxon) GROUP BY ALL),
    w AS (SELECT functional_group, coalesce(sum(amount) FILTER (WHERE state='glacial'),0) AS glacial, coalesce(sum(amount) FILTER (WHERE state='warm'),0) AS warm FROM x GROUP BY ALL),
    k AS (SELECT functional_group, sum(degree)*1.0/count(*) AS mean_degree FROM degrees JOIN taxa USING (taxon) GROUP BY ALL), q AS (SELECT quantile_cont(mean_degree,0.75) AS cut FROM k)
    SELECT functional_group, glacial, warm, round(log2((glacial+1e-6)/(warm+1e-6)),6) AS enrichment, coalesce(mean_degree>=cut,false) AS hub FROM w LEFT JOIN k USING (functional_group), q""",
)
def functional_master(d: Domain):
    """Amounts of every functional group by state, their enrichment, and whether the group's mean degree is in the upper quarter."""
    glacial = F.col("mis") > 4
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("abundance"))), F.lit(0.0))
    w = d.clr_primary.join(d.taxa, "taxon").groupBy("functional_group").agg(amount(glacial).alias("glacial"), amount(~glacial).alias("warm"))
    k = graphs.degrees(d.edges).join(d.taxa, "taxon").groupBy("functional_group").agg((F.sum("degree") / n_rows()).alias("mean_degree"))
    cut = k.agg(F.percentile("mean_degree", F.lit(0.75)).alias("cut"))
    out = w.join(k, "functional_group", "left").crossJoin(F.broadcast(cut))
    ratio = F.log2((F.col("glacial") + 1e-6) / (F.col("warm") + 1e-6))
    return out.select("functional_group", "glacial", "warm", F.round(ratio, 6).alias("enrichment"), F.coalesce(F.col("mean_degree") >= F.col("cut"), F.lit(False)).alias("hub"))
