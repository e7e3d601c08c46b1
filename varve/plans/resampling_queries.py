"""Stability of edges and modules under resampled samples, and preservation of modules between cores."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import resampling
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import Domain

REPLICATES, PERMUTATIONS, REFERENCE = 10, 20, "AFRICA"
#: Modules are the nodes connected by correlations of at least this size.
MODULE_CUTOFF, MODULE_SIZE = 0.8, 3

_DRAWS = f"""draws AS (SELECT core, replicate, label FROM (SELECT i.core, b AS replicate, i.label FROM (SELECT core, label, row_number() OVER (PARTITION BY core ORDER BY label)-1 AS k, count(*) OVER (PARTITION BY core) AS n FROM meta) s
  CROSS JOIN (SELECT unnest(range(1,{REPLICATES + 1})) AS b) JOIN (SELECT core, label, row_number() OVER (PARTITION BY core ORDER BY label)-1 AS k FROM meta) i
  ON i.core=s.core AND i.k=(('0x'||substr(md5(b::VARCHAR||':'||s.core||':'||s.k::VARCHAR),1,8))::BIGINT % s.n)) UNION ALL SELECT core, 0, label FROM meta),
drawn AS (SELECT d.core, d.replicate, d.label, count(*) AS times FROM draws d GROUP BY ALL),
enough AS (SELECT core FROM meta GROUP BY core HAVING count(*)>=8),
rs AS (SELECT core, replicate, src, dst, (n*sxy-sx*sy)/sqrt((n*sxx-sx*sx)*(n*syy-sy*sy)) AS r FROM (
  SELECT a.core, d.replicate, a.taxon AS src, b.taxon AS dst, sum(times) AS n, sum(times*a.clr) AS sx, sum(times*b.clr) AS sy, sum(times*a.clr*b.clr) AS sxy, sum(times*a.clr*a.clr) AS sxx, sum(times*b.clr*b.clr) AS syy
  FROM clr5 a JOIN clr5 b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon JOIN drawn d ON d.core=a.core AND d.label=a.label WHERE a.core IN (SELECT core FROM enough) GROUP BY ALL)
  WHERE n*sxx-sx*sx>1e-18 AND n*syy-sy*sy>1e-18)"""


@query(
    "g17_edge_support",
    f""", {_DRAWS} SELECT core, src, dst, round(max(r) FILTER (WHERE replicate=0),6) AS r, count(*) FILTER (WHERE replicate>0) AS support, round(min(r) FILTER (WHERE replicate>0),6) AS least_r, round(max(r) FILTER (WHERE replicate>0),6) AS largest_r
    FROM rs WHERE abs(r)>=0.55 GROUP BY core, src, dst HAVING count(*) FILTER (WHERE replicate=0)=1""",
)
def edge_support(d: Domain):
    """Edges of the data with the number of resamples in which they stay, and the extremes of their correlation there."""
    edges = resampling.resampled_edges(d.clr_primary, REPLICATES)
    again = F.when(F.col("replicate") > 0, F.col("r"))
    found = edges.groupBy("core", "src", "dst").agg(F.max(F.when(F.col("replicate") == 0, F.col("r"))).alias("r"), F.count(again).alias("support"), F.min(again).alias("least_r"), F.max(again).alias("largest_r"))
    return found.where("r is not null").select("core", "src", "dst", F.round("r", 6).alias("r"), "support", F.round("least_r", 6).alias("least_r"), F.round("largest_r", 6).alias("largest_r"))


@query(
    "g17_module_stability",
    f""", {_DRAWS}, strong AS (SELECT core, replicate, src, dst FROM rs WHERE abs(r)>={MODULE_CUTOFF}), ways AS (SELECT core, replicate, src AS a, dst AS b FROM strong UNION ALL SELECT core, replicate, dst, src FROM strong),
    reach(core, replicate, a, b) AS (SELECT DISTINCT core, replicate, a, a FROM ways UNION SELECT x.core, x.replicate, x.a, w.b FROM reach x JOIN ways w ON w.core=x.core AND w.replicate=x.replicate AND w.a=x.b),
    mods AS (SELECT core, replicate, a AS node, min(b) AS module FROM reach GROUP BY ALL), sizes AS (SELECT core, replicate, module, count(*) AS size FROM mods GROUP BY ALL),
    base AS (SELECT core, module, size FROM sizes WHERE replicate=0 AND size>={MODULE_SIZE}),
    met AS (SELECT b.core, b.module, b.size, m.replicate, m.module AS matched, count(*) AS shared FROM base b JOIN mods o ON o.core=b.core AND o.replicate=0 AND o.module=b.module JOIN mods m ON m.core=o.core AND m.node=o.node AND m.replicate>0 GROUP BY ALL),
    scored AS (SELECT met.*, s.size AS matched_size, shared*1.0/(met.size+s.size-shared) AS j FROM met JOIN sizes s ON s.core=met.core AND s.replicate=met.replicate AND s.module=matched),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY core, module, replicate ORDER BY j DESC, matched)=1),
    grid AS (SELECT core, module, size, unnest(range(1,{REPLICATES + 1})) AS replicate FROM base)
    SELECT g.core, g.module, any_value(g.size) AS size, count(*) AS n, round(quantile_cont(coalesce(j,0),0.5),6) AS jaccard_median, round(quantile_cont(coalesce(j,0),0.05),6) AS jaccard_p05, round(quantile_cont(coalesce(j,0),0.95),6) AS jaccard_p95,
      round(quantile_cont(coalesce(matched_size,0)*1.0/g.size,0.5),6) AS size_ratio_median FROM grid g LEFT JOIN best b ON b.core=g.core AND b.module=g.module AND b.replicate=g.replicate GROUP BY g.core, g.module""",
)
def module_stability(d: Domain):
    """How well the modules of the data are found again in resamples: quantiles of the best Jaccard similarity and of the sizes."""
    ws = Workspace(d.spark, "stability")
    edges = ws.table(resampling.resampled_edges(d.clr_primary, REPLICATES, MODULE_CUTOFF), "edges")
    modules = ws.table(resampling.linked_modules(edges), "modules")
    found = resampling.best_matches(modules, REPLICATES, MODULE_SIZE)
    quantile = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)
    ratio = F.col("matched_size") / F.col("size")
    return found.groupBy("core", "module").agg(
        F.any_value("size").alias("size"),
        F.count(F.lit(1)).alias("n"),
        quantile("jaccard", 0.5).alias("jaccard_median"),
        quantile("jaccard", 0.05).alias("jaccard_p05"),
        quantile("jaccard", 0.95).alias("jaccard_p95"),
        quantile(ratio, 0.5).alias("size_ratio_median"),
    )


@query(
    "g16_module_preservation",
    f""", m AS (SELECT DISTINCT t.taxon AS node, t.functional_group AS module FROM taxa t WHERE t.taxon IN (SELECT taxon FROM clr5)), spread AS (SELECT p, node, module, row_number() OVER (PARTITION BY p ORDER BY node) AS given,
      row_number() OVER (PARTITION BY p ORDER BY md5(p::VARCHAR||':'||node), node) AS hashed FROM m, (SELECT unnest(range(0,{PERMUTATIONS + 1})) AS p)),
    labels AS (SELECT x.p, x.node, y.module FROM spread x JOIN spread y ON y.p=x.p AND y.given=CASE WHEN x.p=0 THEN x.given ELSE x.hashed END),
    r AS (SELECT a.core, a.taxon AS src, b.taxon AS dst, corr(a.clr,b.clr) AS r FROM clr5 a JOIN clr5 b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon GROUP BY ALL HAVING stddev_pop(a.clr)>1e-12 AND stddev_pop(b.clr)>1e-12),
    two AS (SELECT h.core, h.src, h.dst, h.r AS h, t.r AS t FROM r h JOIN r t USING (src, dst) WHERE t.core='{REFERENCE}' AND h.core<>'{REFERENCE}' AND isfinite(h.r) AND isfinite(t.r)),
    s AS (SELECT core, x.module, x.p, avg(h) AS density, CASE WHEN count(*)>=3 AND sqrt((count(*)*sum(h*h)-sum(h)*sum(h))*(count(*)*sum(t*t)-sum(t)*sum(t)))>1e-12 THEN corr(h,t) END AS conn FROM two JOIN labels x ON x.node=src JOIN labels y ON y.node=dst AND y.p=x.p AND y.module=x.module GROUP BY ALL),
    z AS (SELECT core, module, max(density) FILTER (WHERE p=0) AS density, max(conn) FILTER (WHERE p=0) AS connectivity, (max(density) FILTER (WHERE p=0)-avg(density) FILTER (WHERE p>0))/nullif(stddev_samp(density) FILTER (WHERE p>0),0) AS zd,
      (max(conn) FILTER (WHERE p=0)-avg(conn) FILTER (WHERE p>0))/nullif(stddev_samp(conn) FILTER (WHERE p>0),0) AS zc FROM s GROUP BY ALL)
    SELECT core, module, n AS size, round(density,6) AS density, round(connectivity,6) AS connectivity, round(zd,6) AS z_density, round(zc,6) AS z_connectivity, round((zd+zc)/2,6) AS z_summary,
      CASE WHEN (zd+zc)/2>10 THEN 'strong' WHEN (zd+zc)/2>2 THEN 'moderate' ELSE 'weak' END AS preserved FROM z JOIN (SELECT module, count(*) AS n FROM m GROUP BY 1) USING (module)""",
)
def module_preservation(d: Domain):
    """Whether the functional groups hold together in the other cores as in the reference core, against random groups of the same sizes."""
    ws = Workspace(d.spark, "preservation")
    clr = ws.table(d.clr_primary.select("core", "label", "taxon", "clr"), "clr")
    modules = ws.table(d.taxa.select(F.col("taxon").alias("node"), F.col("functional_group").alias("module")).join(clr.select(F.col("taxon").alias("node")).distinct(), "node"), "modules")
    found = resampling.preservation(clr, modules, REFERENCE, PERMUTATIONS)
    preserved = F.when(F.col("z_summary") > 10, "strong").when(F.col("z_summary") > 2, "moderate").otherwise("weak")
    rounded = [F.round(c, 6).alias(c) for c in ("density", "connectivity", "z_density", "z_connectivity", "z_summary")]
    return found.select("core", "module", "size", *rounded, preserved.alias("preserved"))
