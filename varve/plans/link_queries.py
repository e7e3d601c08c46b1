"""Link features, hold-out by core, and predicted taxon-taxon and taxon-site links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.operators import links, ordered
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import CORES, Domain

#: Age bins of a profile: width in kyr and number; the last one is open.
BIN_KYR, BINS = 25, 6
SEED = 42


def profiles(d: Domain, cores: list[str]) -> DataFrame:
    """``(node, x)``: mean log-ratio of every taxon per core and age bin, 0 where a bin holds no sample."""
    bin_ = F.least(F.floor(F.col("age_kyr") / BIN_KYR), F.lit(BINS - 1))
    means = [F.coalesce(F.avg(F.when((F.col("core") == c) & (bin_ == b), F.col("clr"))), F.lit(0.0)) for c in cores for b in range(BINS)]
    return d.clr_primary.groupBy(F.col("taxon").alias("node")).agg(F.array(*means).alias("x"))


def sites(d: Domain) -> DataFrame:
    """``(node, sites)``: 1 for every core in which the taxon is seen, in the order of the cores."""
    seen = [F.max(F.when((F.col("core") == c) & (F.col("abundance") > 0), 1.0).otherwise(0.0)) for c in CORES]
    return d.clr_primary.groupBy(F.col("taxon").alias("node")).agg(F.array(*seen).alias("sites"))


def _as_links(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")


def nodes(d: Domain, edges: DataFrame, cores: list[str]) -> DataFrame:
    """Nodes of :mod:`varve.operators.links` by the profiles over ``cores`` and the edges given."""
    x = profiles(d, cores)
    return links.diffused(x, _as_links(edges), len(cores) * BINS).join(sites(d), "node")


def _vectors(name: str, where: str) -> str:
    """Views ``name``p to ``name``z of the vectors by the cores that ``where`` keeps."""
    return f"""{name}p AS (SELECT taxon, core||':'||least(floor(age_kyr/{BIN_KYR}),{BINS - 1})::INT AS dim, avg(clr) AS x FROM clr5 WHERE {where} GROUP BY ALL),
    {name}l AS (SELECT * FROM links WHERE {where}), {name}s AS (SELECT src AS taxon, sum(weight) AS s FROM {name}l GROUP BY 1),
    {name}g AS (SELECT l.src AS taxon, p.dim, sum(l.weight*p.x/sqrt(e.s))/sqrt(any_value(o.s)) AS g FROM {name}l l JOIN {name}p p ON p.taxon=l.dst JOIN {name}s e ON e.taxon=l.dst JOIN {name}s o ON o.taxon=l.src GROUP BY ALL),
    {name}z AS (SELECT p.taxon, p.dim, p.x+coalesce(g.g,0) AS z FROM {name}p p LEFT JOIN {name}g g ON g.taxon=p.taxon AND g.dim=p.dim)"""


@query(
    "m09_link_features",
    f""", {_vectors("v", "true")}, n AS (SELECT taxon, sqrt(sum(z*z)) AS len FROM vz GROUP BY 1),
    cores AS (SELECT taxon, count(DISTINCT core) FILTER (WHERE abundance>0) AS n_cores, list(DISTINCT core) FILTER (WHERE abundance>0) AS cores FROM clr5 GROUP BY taxon),
    dots AS (SELECT a.taxon AS src, b.taxon AS dst, sum(a.z*b.z) AS dot FROM vz a JOIN vz b ON a.dim=b.dim AND a.taxon<b.taxon GROUP BY ALL)
    SELECT src, dst, round(dot/greatest(m.len*n.len,1e-12),6) AS cosine, len(list_intersect(a.cores,b.cores))::INT AS shared_cores, least(a.n_cores,b.n_cores) AS min_prevalence, greatest(a.n_cores,b.n_cores) AS max_prevalence
    FROM dots JOIN n m ON m.taxon=src JOIN n ON n.taxon=dst JOIN cores a ON a.taxon=src JOIN cores b ON b.taxon=dst WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.src=dots.src AND e.dst=dots.dst)""",
)
def link_features(d: Domain):
    """Features of every pair of taxa without an edge in any core."""
    ws = Workspace(d.spark, "links")
    d = d.stored(ws)
    edges = ws.table(d.edges, "edges")
    found = links.absent_by_blocks(ws.table(nodes(d, edges, CORES), "nodes"), _as_links(edges).select("a", "b").distinct())
    return found.select(
        F.col("a").alias("src"),
        F.col("b").alias("dst"),
        F.round("cosine", 6).alias("cosine"),
        F.col("shared_sites").cast("int").alias("shared_cores"),
        F.col("min_sites").cast("long").alias("min_prevalence"),
        F.col("max_sites").cast("long").alias("max_prevalence"),
    )


def _holdout_sql(core: str) -> str:
    c = core.lower()
    number = "('0x'||substr(md5({0}),1,15))::BIGINT"
    return f"""{_vectors(c, f"core<>'{core}'")}, {c}o AS (SELECT DISTINCT src AS a, dst AS b FROM edges WHERE core='{core}'), {c}t AS (SELECT taxon, row_number() OVER (ORDER BY taxon)-1 AS i FROM (SELECT DISTINCT taxon FROM clr5)),
    {c}k AS (SELECT n, size, size*(size-1)//2-n AS absent FROM (SELECT count(*) AS n FROM {c}o), (SELECT count(*) AS size FROM {c}t)),
    {c}c AS (SELECT x.taxon AS a, y.taxon AS b FROM {c}t x JOIN {c}t y ON x.taxon<y.taxon, {c}k WHERE absent<2*n
      UNION SELECT least(x.taxon,y.taxon), greatest(x.taxon,y.taxon) FROM (SELECT {number.format(f"'a|{SEED}|'||k")} AS p, {number.format(f"'b|{SEED}|'||k")} AS q FROM (SELECT unnest(range(8*n)) AS k FROM {c}k WHERE absent>=2*n)), {c}k
        JOIN {c}t x ON x.i=p%size JOIN {c}t y ON y.i=q%size WHERE x.taxon<>y.taxon),
    {c}n AS (SELECT a, b FROM {c}c ANTI JOIN {c}o USING (a, b) QUALIFY row_number() OVER (ORDER BY {number.format(f"'{SEED}|'||a||'|'||b")}, a, b)<=(SELECT n FROM {c}k)),
    {c}r AS (SELECT '{core}' AS core, label, round(sum(x.z*y.z),6) AS score FROM (SELECT a, b, 1 AS label FROM {c}o UNION ALL SELECT a, b, 0 FROM {c}n) JOIN {c}z x ON x.taxon=a JOIN {c}z y ON y.taxon=b AND y.dim=x.dim GROUP BY a, b, label)"""


@query(
    "m03_link_holdout",
    ", "
    + ", ".join(_holdout_sql(c) for c in CORES)
    + f""", scored AS ({" UNION ALL ".join(f"SELECT * FROM {c.lower()}r" for c in CORES)}), steps AS (SELECT core, score, sum(label) AS p, sum(1-label) AS q FROM scored GROUP BY ALL),
    run AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM steps WINDOW w AS (PARTITION BY core ORDER BY score DESC))
    SELECT core, sum(p)::BIGINT AS n_positive, sum(q)::BIGINT AS n_negative, round(sum(q*(cp-p+p/2.0))/nullif(sum(p)*sum(q),0),6) AS auc, round(sum(p*cp*1.0/(cp+cq))/nullif(sum(p),0),6) AS average_precision FROM run GROUP BY core""",
)
def link_holdout(d: Domain):
    """How well vectors of the other cores tell the edges of a core from as many absent pairs, for every core as the one held out."""
    ws = Workspace(d.spark, "holdout")
    d = d.stored(ws)
    edges = ws.table(d.edges, "edges")
    rows = None
    for core in CORES:
        others = [c for c in CORES if c != core]
        known = ws.table(nodes(d, edges.where(F.col("core") != core), others), "nodes")
        observed = ws.table(_as_links(edges.where(F.col("core") == core)).select("a", "b").distinct(), "observed")
        absent = links.sample_absent(known, observed, observed.count(), SEED, ws)
        pairs = observed.withColumn("label", F.lit(1)).unionByName(absent.withColumn("label", F.lit(0)))
        end = lambda c: known.select(F.col("node").alias(c), F.col("z").alias(f"z{c}"))
        scored = pairs.join(end("a"), "a").join(end("b"), "b").select(F.lit(core).alias("core"), "label", F.round(C.dot("za", "zb"), 6).alias("score"))
        rows = scored if rows is None else rows.unionByName(scored)
    found = ordered.ranking_quality(ws.table(rows, "scored"), ["core"])
    return found.select("core", "n_positive", "n_negative", F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


def predicted_links(known: DataFrame, observed: DataFrame, ws: Workspace) -> DataFrame:
    """Scores of all pairs of nodes that are not observed, best first, by a model of observed and as many absent pairs.

    Without an observed or without an absent pair there is nothing to learn from, and no row.
    """
    absent = ws.table(links.sample_absent(known, observed, observed.count(), SEED, ws), "absent")
    if observed.isEmpty() or absent.isEmpty():
        model, auc, precision, scored = None, None, None, links.absent_by_blocks(known.limit(0), observed)
    else:
        pairs = observed.withColumn("label", F.lit(1)).unionByName(absent.withColumn("label", F.lit(0)))
        rows = ws.table(links.pair_features(pairs, known), "rows")
        model, auc, precision = links.evaluated_fit(rows, links.FEATURES, ["a", "b"], ws)
        scored = links.absent_by_blocks(known, observed, model)
    ranked = ordered.positions(scored, [F.desc("score"), F.col("a"), F.col("b")], ws=ws)
    return ranked.select("*", F.lit(auc).cast("double").alias("holdout_auc"), F.lit(precision).cast("double").alias("holdout_ap"), (F.col("position") + 1).alias("rank")).drop("position")


@query("m10_link_prediction")
def link_prediction(d: Domain):
    """Every pair of taxa without an edge, scored by the calibrated model of its features."""
    ws = Workspace(d.spark, "links")
    d = d.stored(ws)
    edges = ws.table(d.edges, "edges")
    known = ws.table(nodes(d, edges, CORES), "nodes")
    found = predicted_links(known, ws.table(_as_links(edges).select("a", "b").distinct(), "observed"), ws)
    return found.select(
        F.col("a").alias("taxon_from"),
        F.col("b").alias("taxon_to"),
        F.round("score", 6).alias("latent_score"),
        F.round("cosine", 6).alias("cosine_similarity"),
        F.col("shared_sites").cast("long").alias("shared_core_count"),
        F.col("min_sites").cast("long").alias("min_core_prevalence"),
        F.col("max_sites").cast("long").alias("max_core_prevalence"),
        F.lit("absent").alias("observed_status"),
        F.round("holdout_auc", 6).alias("holdout_auc"),
        F.round("holdout_ap", 6).alias("holdout_ap"),
        "rank",
    )


SITE_FEATURES = ["cosine", "prevalence", "samples", "age_mean", "age_span"]


@query("m10_site_links")
def site_links(d: Domain):
    """Every core in which a taxon is not seen, scored by a model of vector similarity, prevalence, sample count and ages.

    A core's vector is the mean of its taxa's. Candidates are taxa x cores less what is seen, so no more than ``CORES`` rows a taxon.
    """
    ws = Workspace(d.spark, "site-links")
    d = d.stored(ws)
    edges = ws.table(d.edges, "edges")
    known = ws.table(nodes(d, edges, CORES), "nodes")
    dims = len(CORES) * BINS
    grid = known.select("node", "z", "sites", F.posexplode(F.array(*[F.lit(c) for c in CORES])).alias("at", "core")).withColumn("label", F.expr("sites[at]").cast("int"))
    of_site = grid.where("label = 1").groupBy("core").agg(F.array(*[F.avg(F.col("z")[k]) for k in range(dims)]).alias("site_z"))
    ages = d.meta.groupBy("core").agg(F.count(F.lit(1)).cast("double").alias("samples"), F.avg("age_kyr").alias("age_mean"), (F.max("age_kyr") - F.min("age_kyr")).alias("age_span"))
    prevalence = F.aggregate("sites", F.lit(0.0), lambda u, v: u + v)
    rows = grid.join(F.broadcast(of_site), "core").join(F.broadcast(ages), "core").select(F.col("node").alias("taxon"), "core", "label", C.cosine("z", "site_z").alias("cosine"), prevalence.alias("prevalence"), "samples", "age_mean", "age_span")
    rows = ws.table(rows, "rows")
    n = rows.where("label = 1").count()
    kinds = ordered.positions(rows.withColumn("h", links.hashed(F.lit(SEED + 1), F.col("taxon"), F.col("core"))), [F.col("h"), F.col("taxon"), F.col("core")], ["label"], ws=ws)
    chosen = ws.table(kinds.where((F.col("label") == 1) | (F.col("position") < n)).drop("h", "position"), "chosen")
    absent = rows.where("label = 0")
    if n == 0 or absent.isEmpty():
        scored, auc, precision = absent.limit(0).withColumn("score", F.lit(None).cast("double")), None, None
    else:
        model, auc, precision = links.evaluated_fit(chosen, SITE_FEATURES, ["taxon", "core"], ws)
        scored = absent.withColumn("score", model.score(SITE_FEATURES))
    ranked = ordered.positions(scored, [F.desc("score"), F.col("taxon"), F.col("core")], ws=ws)
    return ranked.select(
        "taxon",
        "core",
        F.round("score", 6).alias("latent_score"),
        F.round("cosine", 6).alias("cosine_similarity"),
        F.col("prevalence").cast("long").alias("taxon_prevalence_cores"),
        F.col("samples").cast("long").alias("site_sample_count"),
        F.round("age_mean", 6).alias("site_age_mean_kyr"),
        F.round("age_span", 6).alias("site_age_span_kyr"),
        F.lit("absent").alias("observed_status"),
        F.lit(auc).cast("double").alias("holdout_auc"),
        F.lit(precision).cast("double").alias("holdout_ap"),
        (F.col("position") + 1).alias("rank"),
    )
