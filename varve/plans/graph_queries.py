"""Association graphs, their comparison and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.functions.columns import n_rows
from varve.operators import graphs, ordered
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import Domain

W = Window.partitionBy
SIGN = "CASE WHEN signed_weight>=0 THEN 'positive' ELSE 'negative' END"


def vertices(d: Domain) -> DataFrame:
    return d.clr_primary.select("core", "taxon").distinct()


def modules(d: Domain) -> DataFrame:
    return d.taxa.select("taxon", F.col("functional_group").alias("module"))


@query("g01_association_edges", "SELECT core, src, dst, round(signed_weight,6) AS signed_weight FROM edges")
def association_edges(d: Domain):
    return d.edges.select("core", "src", "dst", F.round("signed_weight", 6).alias("signed_weight"))


@query(
    "g02_mutual_information",
    """, ranked AS (SELECT core,label,taxon, rank() OVER (PARTITION BY core,taxon ORDER BY clr)+(count(*) OVER (PARTITION BY core,taxon,clr)-1)/2.0 AS k FROM clr5),
    rho AS (SELECT a.core, a.taxon src, b.taxon dst, corr(a.k,b.k) r FROM ranked a JOIN ranked b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon
      GROUP BY ALL HAVING count(*)>=8 AND stddev_pop(a.k)>0 AND stddev_pop(b.k)>0)
    SELECT core, src, dst, round(-0.5*ln(1-least(r*r,0.999999)),6) AS mi FROM rho WHERE round(-0.5*ln(1-least(r*r,0.999999)),6)>0.01""",
)
def mutual_information(d: Domain):
    r = graphs.correlations(d.clr_primary, "spearman")
    return r.select("core", "src", "dst", F.round(graphs.mutual_information(), 6).alias("mi")).where("mi > 0.01")


@query("g03_core_dispatch", "SELECT core, count(*) AS samples FROM meta GROUP BY core HAVING count(*)>=8")
def core_dispatch(d: Domain):
    return d.meta.groupBy("core").agg(n_rows().alias("samples")).where("samples >= 8")


@query(
    "g04_aracne",
    """, ranked AS (SELECT core, label, taxon, rank() OVER (PARTITION BY core, taxon ORDER BY clr)+(count(*) OVER (PARTITION BY core, taxon, clr)-1)/2.0 AS k FROM clr5),
    rho AS (SELECT a.core, a.taxon AS src, b.taxon AS dst, corr(a.k,b.k) AS r FROM ranked a JOIN ranked b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon GROUP BY ALL HAVING count(*)>=8 AND stddev_pop(a.k)>0 AND stddev_pop(b.k)>0),
    mi AS (SELECT core, src, dst, round(-0.5*ln(1-least(r*r,0.999999)),10) AS w FROM rho WHERE round(-0.5*ln(1-least(r*r,0.999999)),10)>0), ways AS (SELECT core, src AS a, dst AS b, w FROM mi UNION ALL SELECT core, dst, src, w FROM mi)
    SELECT core, src, dst, round(w,6) AS mi FROM mi WHERE NOT EXISTS (SELECT 1 FROM ways x JOIN ways y ON y.core=x.core AND y.a=x.b WHERE x.core=mi.core AND x.a=mi.src AND y.b=mi.dst AND mi.w<least(x.w,y.w))""",
)
def aracne(d: Domain):
    return graphs.association_graph(d.clr_primary, "mi_aracne").select("core", "src", "dst", F.round("weight", 6).alias("mi"))


@query(
    "g05_graph_summary",
    """, reach(core, a, b) AS (SELECT DISTINCT core, taxon, taxon FROM clr5 UNION SELECT r.core, r.a, l.dst FROM reach r JOIN links l ON l.core=r.core AND l.src=r.b),
    heads AS (SELECT core, b AS taxon, min(a) AS component FROM reach GROUP BY core, b)
    SELECT core, nodes, components, edges, round(2.0*edges/(nodes*(nodes-1)),6) AS density FROM (SELECT core, count(*) AS nodes, count(DISTINCT component) AS components FROM heads GROUP BY core)
    JOIN (SELECT core, count(*) AS edges FROM edges GROUP BY core) USING (core)""",
)
def graph_summary(d: Domain):
    s = graphs.summary(d.edges, vertices(d)).where("edges > 0")
    return s.select("core", "nodes", "components", "edges", F.round("density", 6).alias("density"))


@query("g06_spectral_signature")
def spectral_signature(d: Domain):
    return graphs.spectral_signatures(d.edges, vertices(d))


@query(
    "g07_edge_jaccard",
    """, sizes AS (SELECT core, count(*) AS m FROM edges GROUP BY core),
    shared AS (SELECT a.core ca, b.core cb, count(*) s FROM edges a JOIN edges b USING (src, dst) WHERE a.core<b.core GROUP BY ALL)
    SELECT a.core AS core_a, b.core AS core_b, coalesce(s,0) AS edge_intersection, a.m+b.m-coalesce(s,0) AS edge_union, round(coalesce(s,0)*1.0/(a.m+b.m-coalesce(s,0)),6) AS edge_jaccard
    FROM sizes a JOIN sizes b ON a.core<b.core LEFT JOIN shared ON ca=a.core AND cb=b.core""",
)
def edge_jaccard(d: Domain):
    return graphs.edge_jaccard(d.edges).withColumn("edge_jaccard", F.round("edge_jaccard", 6))


@query(
    "g10_heterograph_edges",
    f"""SELECT 'taxon_taxon__'||core||'__'||{SIGN} AS edge_type, src AS a, dst AS b, round(weight,6) AS weight FROM edges
    UNION ALL SELECT 'taxon_site', taxon, core, round(avg((abundance>0)::INT),6) FROM clr5 GROUP BY taxon, core HAVING max(abundance)>0""",
)
def heterograph_edges(d: Domain):
    sign = F.when(F.col("signed_weight") >= 0, "positive").otherwise("negative")
    between = d.edges.select(F.concat_ws("__", F.lit("taxon_taxon"), "core", sign).alias("edge_type"), F.col("src").alias("a"), F.col("dst").alias("b"), F.round("weight", 6).alias("weight"))
    site = d.clr_primary.groupBy("taxon", "core").agg(F.avg((F.col("abundance") > 0).cast("int")).alias("p")).where("p > 0")
    return between.union(site.select(F.lit("taxon_site"), "taxon", "core", F.round("p", 6)))


@query("g11_index_space", "SELECT taxon, (row_number() OVER (ORDER BY taxon)-1)::INT AS idx FROM prevalent WHERE threshold=5")
def index_space(d: Domain):
    placed = ordered.positions(d.prevalent.where("threshold = 5").select("taxon"), [F.col("taxon")])
    return placed.select("taxon", F.col("position").cast("int").alias("idx"))


@query(
    "g12_topological_overlap",
    """, common AS (SELECT a.core, a.src, b.dst, sum(a.weight*b.weight) AS s FROM links a JOIN links b ON a.core=b.core AND a.dst=b.src AND a.src<b.dst GROUP BY ALL)
    SELECT e.core, e.src, e.dst, round((coalesce(s,0)+e.weight)/(least(a.strength,b.strength)+1-e.weight),6) AS tom FROM edges e
    JOIN degrees a ON a.core=e.core AND a.taxon=e.src JOIN degrees b ON b.core=e.core AND b.taxon=e.dst LEFT JOIN common c ON c.core=e.core AND c.src=e.src AND c.dst=e.dst""",
)
def topological_overlap(d: Domain):
    links = graphs.both_ways(d.edges).select("core", "src", "dst", "weight")
    one = links.select("core", "src", F.col("dst").alias("mid"), F.col("weight").alias("w1"))
    two = links.select("core", F.col("src").alias("mid"), "dst", F.col("weight").alias("w2"))
    common = one.join(two, ["core", "mid"]).where("src < dst").groupBy("core", "src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("s"))
    k = graphs.degrees(d.edges)
    e = d.edges.select("core", "src", "dst", "weight").join(common, ["core", "src", "dst"], "left")
    e = e.join(k.select("core", F.col("taxon").alias("src"), F.col("strength").alias("ka")), ["core", "src"])
    e = e.join(k.select("core", F.col("taxon").alias("dst"), F.col("strength").alias("kb")), ["core", "dst"])
    w = F.col("weight")
    return e.select("core", "src", "dst", F.round((F.coalesce("s", F.lit(0.0)) + w) / (F.least("ka", "kb") + 1 - w), 6).alias("tom"))


@query(
    "g13_soft_power",
    """SELECT core, power, round(avg(k),6) AS mean_k FROM (SELECT core, taxon, power, sum(pow((1+r)/2,power)) AS k FROM (SELECT core, src AS taxon, r FROM corrs UNION ALL SELECT core, dst, r FROM corrs),
    (VALUES (2),(4),(6),(8)) t(power) GROUP BY ALL) GROUP BY ALL""",
)
def soft_power(d: Domain):
    r = graphs.correlations(d.clr_primary)
    both = r.select("core", F.explode(F.array("src", "dst")).alias("taxon"), "r")
    swept = both.withColumn("power", F.explode(F.array(*[F.lit(p) for p in (2, 4, 6, 8)])))
    k = swept.groupBy("core", "taxon", "power").agg(F.sum(F.pow((1 + F.col("r")) / 2, "power")).alias("k"))
    return k.groupBy("core", "power").agg(F.round(F.avg("k"), 6).alias("mean_k"))


#: Powers that are tried, bins of the connectivity distribution, and the fit that is wanted.
POWERS, FIT_BINS, WANTED_FIT = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 20), 10, 0.8

_SCALE_FREE = f""", k AS (SELECT core, taxon, power, sum(pow((1+r)/2,power)) AS k FROM (SELECT core, src AS taxon, r FROM corrs UNION ALL SELECT core, dst, r FROM corrs), (SELECT unnest({list(POWERS)}) AS power) GROUP BY ALL),
    e AS (SELECT core, power, min(k) AS lo, max(k) AS hi, count(*) AS n, avg(k) AS mean_k FROM k GROUP BY ALL),
    bins AS (SELECT core, power, greatest(ceil(round((k-lo)/(hi-lo)*{FIT_BINS},9))-1,0)::INT AS bin, avg(k) AS k, count(*) AS c FROM k JOIN e USING (core, power) WHERE hi-lo>1e-12 GROUP BY ALL),
    pts AS (SELECT g.core, g.power, ln(coalesce(b.k, lo+(hi-lo)*(g.bin+0.5)/{FIT_BINS})) AS x, ln(coalesce(b.c,0)*1.0/n+1e-9) AS y FROM (SELECT *, unnest(range({FIT_BINS})) AS bin FROM e WHERE hi-lo>1e-12) g LEFT JOIN bins b ON b.core=g.core AND b.power=g.power AND b.bin=g.bin),
    fit AS (SELECT core, power, corr(x,y) AS c FROM pts GROUP BY ALL), scored AS (SELECT e.core, e.power, -sign(c)*c*c AS fit, mean_k FROM e LEFT JOIN fit USING (core, power))"""


def scale_free_fits(d: Domain) -> DataFrame:
    """``(core, power, mean_k, fit)``: mean connectivity and signed R2 of ln p(k) on ln k over ten bins, positive where p(k) falls.

    A bin without taxa stands at its middle with the share 0; without spread there is no fit.
    """
    r = graphs.correlations(d.clr_primary)
    ends = r.select("core", F.explode(F.array("src", "dst")).alias("taxon"), ((1 + F.col("r")) / 2).alias("a"))
    sums = ends.groupBy("core", "taxon").agg(*[F.sum(F.pow("a", F.lit(p))).alias(f"k{p}") for p in POWERS])
    k = sums.select("core", F.explode(F.array(*[F.struct(F.lit(p).alias("power"), F.col(f"k{p}").alias("k")) for p in POWERS])).alias("s")).select("core", "s.*")
    k = Workspace(d.spark, "power").table(k, "connectivity")
    ends = k.groupBy("core", "power").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_k"))
    width = F.col("hi") - F.col("lo")
    place = F.greatest(F.ceil(F.round((F.col("k") - F.col("lo")) / width * FIT_BINS, 9)) - 1, F.lit(0)).cast("int")
    bins = k.join(ends.select("core", "power", "lo", "hi"), ["core", "power"]).where(width > 1e-12).groupBy("core", "power", place.alias("bin")).agg(F.avg("k").alias("k"), F.count(F.lit(1)).alias("c"))
    grid = ends.where(width > 1e-12).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(FIT_BINS - 1)))).join(bins, ["core", "power", "bin"], "left")
    x = F.log(F.coalesce("k", F.col("lo") + width * (F.col("bin") + 0.5) / FIT_BINS))
    y = F.log(F.coalesce("c", F.lit(0)) / F.col("n") + 1e-9)
    fit = grid.groupBy("core", "power").agg(F.corr(x, y).alias("c")).select("core", "power", (-F.signum("c") * F.col("c") * F.col("c")).alias("fit"))
    return ends.select("core", "power", "mean_k").join(fit, ["core", "power"], "left")


@query("g13_scale_free_fit", _SCALE_FREE + " SELECT core, power, round(mean_k,6) AS mean_k, round(fit,5) AS fit FROM scored")
def scale_free_fit(d: Domain):
    """Mean connectivity and signed scale-free fit of every core and power."""
    return scale_free_fits(d).select("core", "power", F.round("mean_k", 6).alias("mean_k"), F.round("fit", 5).alias("fit"))


@query(
    "g13_power_choice",
    _SCALE_FREE
    + f""", own AS (SELECT core, coalesce(min(power) FILTER (WHERE round(fit,5)>={WANTED_FIT}), arg_max(power, round(fit,5)*1000-power)) AS power FROM scored WHERE fit IS NOT NULL GROUP BY core)
    SELECT core, power::INT AS power, max(power) OVER ()::INT AS chosen FROM own""",
)
def power_choice(d: Domain):
    """The smallest power of every core with the wanted fit, else that of the best fit (the smaller of equals), and the largest over the cores."""
    fits = scale_free_fits(d).where("fit is not null").select("core", "power", F.round("fit", 5).alias("fit"))
    own = fits.groupBy("core").agg(F.coalesce(F.min(F.when(F.col("fit") >= WANTED_FIT, F.col("power"))), F.max_by("power", F.col("fit") * 1000 - F.col("power"))).alias("power"))
    own = Workspace(d.spark, "power").table(own, "choice")
    chosen = own.agg(F.max("power").alias("chosen"))
    return own.crossJoin(F.broadcast(chosen))


@query(
    "g18_module_roles",
    """, nodes AS (SELECT l.core, l.src AS taxon, o.functional_group AS module, sum(weight) AS strength, sum(CASE WHEN o.functional_group=p.functional_group THEN weight ELSE 0 END) AS within
      FROM links l JOIN taxa o ON o.taxon=l.src JOIN taxa p ON p.taxon=l.dst GROUP BY ALL),
    squares AS (SELECT core, taxon, sum(k*k) AS q FROM (SELECT l.core, l.src AS taxon, p.functional_group, sum(weight) AS k FROM links l JOIN taxa p ON p.taxon=l.dst GROUP BY ALL) GROUP BY ALL)
    SELECT core, taxon, module, round(1-q/(strength*strength),6) AS participation, round(coalesce((within-avg(within) OVER w)/nullif(stddev_samp(within) OVER w,0),0),5) AS z
    FROM nodes JOIN squares USING (core, taxon) WINDOW w AS (PARTITION BY core, module)""",
)
def module_roles(d: Domain):
    r = graphs.module_roles(d.edges, modules(d))
    return r.select("core", "taxon", "module", F.round("participation", 6).alias("participation"), F.round("z", 5).alias("z"))


_RANKS = ", ".join(
    f"""r{i + 1} AS (SELECT n.core, n.taxon, n.n, 0.15/n.n+0.85*coalesce(g.got,0) AS rank FROM r0 n LEFT JOIN (SELECT s.core, s.dst AS taxon, sum(r.rank*s.share) AS got FROM shares s JOIN r{i} r ON r.core=s.core AND r.taxon=s.src GROUP BY ALL) g
    ON g.core=n.core AND g.taxon=n.taxon)"""
    for i in range(20)
)


@query(
    "g19_page_rank",
    f""", shares AS MATERIALIZED (SELECT core, src, dst, weight/sum(weight) OVER (PARTITION BY core, src) AS share FROM links),
    r0 AS MATERIALIZED (SELECT core, taxon, n, 1.0/n AS rank FROM (SELECT core, taxon, count(*) OVER (PARTITION BY core) AS n FROM (SELECT DISTINCT core, src AS taxon FROM links))), {_RANKS.replace(" AS (SELECT n.core", " AS MATERIALIZED (SELECT n.core")}
    SELECT core, taxon, round(rank,8) AS rank FROM r20""",
)
def page_rank(d: Domain):
    return graphs.page_rank(d.edges).withColumn("rank", F.round("rank", 8))


@query("g21_path_measures")
def path_measures(d: Domain):
    return graphs.path_measures(d.edges)


@query(
    "g20_bridging_coefficient",
    """SELECT a.core, a.taxon, round((1.0/a.degree)/s,6) AS coefficient FROM degrees a JOIN
    (SELECT l.core, l.src AS taxon, sum(1.0/b.degree) AS s FROM links l JOIN degrees b ON b.core=l.core AND b.taxon=l.dst GROUP BY ALL) n ON n.core=a.core AND n.taxon=a.taxon""",
)
def bridging(d: Domain):
    k = graphs.degrees(d.edges).select("core", "taxon", "degree")
    near = graphs.both_ways(d.edges).join(k.select("core", F.col("taxon").alias("dst"), F.col("degree").alias("other")), ["core", "dst"])
    s = near.groupBy("core", F.col("src").alias("taxon")).agg(F.sum(1.0 / F.col("other")).alias("s"))
    return k.join(s, ["core", "taxon"]).select("core", "taxon", F.round(1.0 / F.col("degree") / F.col("s"), 6).alias("coefficient"))


@query(
    "g22_degree_percentile",
    "SELECT core, taxon, round((rank() OVER (PARTITION BY core ORDER BY degree)+(count(*) OVER (PARTITION BY core, degree)-1)/2.0)/count(*) OVER (PARTITION BY core),6) AS percentile FROM degrees",
)
def degree_percentile(d: Domain):
    k = graphs.degrees(d.edges)
    return k.select("core", "taxon", F.round(C.average_rank("degree", ["core"]) / n_rows().over(W("core")), 6).alias("percentile"))


@query(
    "g23_active_subgraph",
    """, means AS (SELECT core, taxon, avg(clr) AS m FROM clr5 GROUP BY ALL), active AS (SELECT core, taxon FROM means JOIN (SELECT core, quantile_cont(m,0.25) AS q FROM means GROUP BY core) USING (core) WHERE m>q+1e-9)
    SELECT core, count(*) AS edges FROM edges e WHERE weight>=0.1 AND (core,src) IN (SELECT core, taxon FROM active) AND (core,dst) IN (SELECT core, taxon FROM active) GROUP BY core""",
)
def active_subgraph(d: Domain):
    m = d.clr_primary.groupBy("core", "taxon").agg(F.avg("clr").alias("m"))
    q = m.groupBy("core").agg(F.percentile("m", F.lit(0.25)).alias("q"))
    active = m.join(q, "core").where("m > q + 1e-9").select("core", "taxon")
    kept = d.edges.where("weight >= 0.1")
    for end in ("src", "dst"):
        kept = kept.join(active.withColumnRenamed("taxon", end), ["core", end], "left_semi")
    return kept.groupBy("core").agg(n_rows().alias("edges"))


@query(
    "g24_module_meta_graph",
    "SELECT core, least(a.functional_group,b.functional_group) AS m1, greatest(a.functional_group,b.functional_group) AS m2, count(*) AS edges, round(sum(weight),5) AS weight FROM edges JOIN taxa a ON a.taxon=src JOIN taxa b ON b.taxon=dst GROUP BY ALL",
)
def meta_graph(d: Domain):
    e = with_modules(d)
    g = e.groupBy("core", F.least("ma", "mb").alias("m1"), F.greatest("ma", "mb").alias("m2"))
    return g.agg(n_rows().alias("edges"), F.round(F.sum("weight"), 5).alias("weight"))


def with_modules(d: Domain) -> DataFrame:
    m = modules(d)
    e = d.edges.join(m.select(F.col("taxon").alias("src"), F.col("module").alias("ma")), "src")
    return e.join(m.select(F.col("taxon").alias("dst"), F.col("module").alias("mb")), "dst")


@query(
    "g25_sparsified",
    """SELECT core, count(*) AS edges, round(avg((a.functional_group=b.functional_group)::INT),6) AS within_fraction FROM edges JOIN (SELECT core, quantile_cont(weight,0.95) AS q FROM edges GROUP BY core) USING (core)
    JOIN taxa a ON a.taxon=src JOIN taxa b ON b.taxon=dst WHERE weight>=q-1e-12 GROUP BY core""",
)
def sparsified(d: Domain):
    q = d.edges.groupBy("core").agg(F.percentile("weight", F.lit(0.95)).alias("q"))
    e = with_modules(d).join(q, "core").where("weight >= q - 1e-12")
    return e.groupBy("core").agg(n_rows().alias("edges"), F.round(F.avg((F.col("ma") == F.col("mb")).cast("int")), 6).alias("within_fraction"))


@query(
    "g26_separation",
    """SELECT core, round(median(weight) FILTER (WHERE a.functional_group=b.functional_group)/median(weight) FILTER (WHERE a.functional_group<>b.functional_group),6) AS ratio
    FROM edges JOIN taxa a ON a.taxon=src JOIN taxa b ON b.taxon=dst GROUP BY core""",
)
def separation(d: Domain):
    med = lambda c: F.median(F.when(c, F.col("weight")))
    same = F.col("ma") == F.col("mb")
    return with_modules(d).groupBy("core").agg(F.round(F.try_divide(med(same), med(~same)), 6).alias("ratio"))


@query(
    "g27_ego_network",
    "SELECT core, src, dst, weight FROM (SELECT core, src, dst, round(weight,6) AS weight, row_number() OVER (PARTITION BY core ORDER BY round(weight,6) DESC, src, dst) rn FROM edges WHERE src=(SELECT min(taxon) FROM taxa) OR dst=(SELECT min(taxon) FROM taxa)) WHERE rn<=5",
)
def ego_network(d: Domain):
    focus = d.taxa.agg(F.min("taxon").alias("focus"))
    e = d.edges.join(F.broadcast(focus), (F.col("src") == F.col("focus")) | (F.col("dst") == F.col("focus"))).withColumn("weight", F.round("weight", 6))
    rn = F.row_number().over(W("core").orderBy(F.desc("weight"), "src", "dst"))
    return e.withColumn("rn", rn).where("rn <= 5").select("core", "src", "dst", "weight")


@query(
    "g29_super_graph_nodes",
    "SELECT core AS node, coalesce(w,0.4::DOUBLE) AS weight FROM (SELECT core FROM samples UNION SELECT core FROM edges) LEFT JOIN (SELECT core, round(avg(weight),6) AS w FROM edges GROUP BY core) USING (core)",
)
def super_graph_nodes(d: Domain):
    nodes = d.samples.select("core").union(d.edges.select("core")).distinct()
    w = d.edges.groupBy("core").agg(F.round(F.avg("weight"), 6).alias("w"))
    return nodes.join(w, "core", "left").select(F.col("core").alias("node"), F.coalesce("w", F.lit(0.4)).alias("weight"))
