"""Correlation, tests, ordination, richness and metabolic indices."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions import columns as C
from varve.operators import graphs, ordered
from varve.operators.staging import Workspace
from varve.functions.columns import n_rows
from varve.plans.base import query
from varve.sources.domain import Domain

W = Window.partitionBy


@query("t01_pearson", "SELECT core, round(corr(mis,sst),6) AS r FROM meta GROUP BY 1 HAVING count(*)>=3")
def pearson(d: Domain):
    return d.meta.groupBy("core").agg(F.round(C.safe_corr("mis", "sst"), 6).alias("r")).where("r is not null")


@query(
    "t02_spearman",
    """SELECT core, src, dst, round(r,6) AS rho FROM (SELECT a.core, a.taxon src, b.taxon dst, corr(a.k,b.k) r, count(*) n FROM ranked a JOIN ranked b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon
    GROUP BY ALL HAVING stddev_pop(a.k)>0 AND stddev_pop(b.k)>0) WHERE n>=8 AND abs(r)>=0.55""".replace("ranked", "(SELECT core,label,taxon, rank() OVER (PARTITION BY core,taxon ORDER BY clr)+(count(*) OVER (PARTITION BY core,taxon,clr)-1)/2.0 AS k FROM clr5)"),
)
def spearman(d: Domain):
    r = graphs.correlations(d.clr_primary, "spearman", cutoff=0.55)
    return r.select("core", "src", "dst", F.round("r", 6).alias("rho"))


@query(
    "t03_bicor",
    """, a1 AS (SELECT core, label, taxon, clr, clr-median(clr) OVER w AS dev, clr-avg(clr) OVER w AS centred FROM clr5 WINDOW w AS (PARTITION BY core, taxon)), a2 AS (SELECT *, median(abs(dev)) OVER (PARTITION BY core, taxon) AS mad FROM a1),
    a3 AS (SELECT core, label, taxon, CASE WHEN mad=0 THEN centred WHEN abs(dev/(9*mad))<1 THEN dev*pow(1-pow(dev/(9*mad),2),2) ELSE 0 END AS c FROM a2), a4 AS (SELECT *, sqrt(sum(c*c) OVER (PARTITION BY core, taxon)) AS len FROM a3),
    p AS (SELECT a.core, a.taxon AS src, b.taxon AS dst, count(*) AS n, sum(a.c/a.len*b.c/b.len) AS r FROM a4 a JOIN a4 b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon WHERE a.len>1e-12 AND b.len>1e-12 GROUP BY ALL)
    SELECT core, src, dst, round(r,6) AS r FROM p WHERE n>=8 AND abs(r)>=0.55""",
)
def bicor(d: Domain):
    return graphs.association_graph(d.clr_primary, "bicor").select("core", "src", "dst", F.round("signed_weight", 6).alias("r"))


def gram_pca(rows: DataFrame, by: str, k: int = 3) -> DataFrame:
    """Scores and explained variance of the k first components of (entity, feature, x) per group.

    Every entity of a group has the same features. Only sums of products of features leave the tasks and meet on the driver,
    so neither a task nor the driver holds more than a batch of entities and the square of the number of features.
    The largest loading of each component is made positive.
    """
    vectors = rows.groupBy(by, "entity").agg(F.array_sort(F.collect_list(F.struct("feature", "x"))).alias("v"))
    stored = Workspace(rows.sparkSession, "pca").table(vectors.select(by, F.col("entity").cast("long").alias("entity"), F.transform("v", lambda v: v["x"]).alias("z")), "vectors")

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per group the products of all features, a last one of ones among them."""
        sums: dict = {}
        for batch in batches:
            for group, part in batch.groupby(by):
                x = np.hstack([np.array(part["z"].tolist(), dtype=float), np.ones((len(part), 1))])
                sums[group] = sums.get(group, 0) + x.T @ x
        for group, m in sums.items():
            yield pd.DataFrame({by: group, "i": np.arange(len(m)), "m": list(m)})

    kind = dict(stored.dtypes)[by]
    parts = stored.mapInPandas(moments, f"{by} {kind}, i int, m array<double>").select(by, "i", F.posexplode("m").alias("j", "x"))
    cells: dict = {}
    for r in parts.groupBy(by, "i", "j").agg(F.sum("x").alias("x")).collect():
        cells.setdefault(r[by], {})[r["i"], r["j"]] = r["x"]
    found = []
    for group, cell in cells.items():
        d = max(i for i, _ in cell)
        m = np.array([[cell[i, j] for j in range(d + 1)] for i in range(d + 1)])
        n, mean = m[d, d], m[d, :d] / m[d, d]
        values, axes = np.linalg.eigh(m[:d, :d] - n * np.outer(mean, mean))
        total = max(float(values.sum()), 1e-300)
        for c, at in enumerate(np.argsort(-values, kind="stable")[: int(min(k, d, n))]):
            load = axes[:, at] * np.sign(axes[np.abs(axes[:, at]).argmax(), at])
            found.append((group, c + 1, load.tolist(), float(mean @ load), max(float(values[at]), 0.0) / total))
    loads = rows.sparkSession.createDataFrame(found, f"{by} {kind}, component int, load array<double>, at_mean double, explained double")
    score = F.aggregate(F.zip_with("z", "load", lambda p, q: p * q), -F.col("at_mean"), lambda s, p: s + p)
    return stored.join(F.broadcast(loads), by).select(by, "entity", "component", score.alias("score"), "explained")  # k rows per group


@query("t04_pca")
def pca(d: Domain):
    return gram_pca(d.clr.select("threshold", F.col("label").alias("entity"), F.col("taxon").alias("feature"), F.col("clr").alias("x")), "threshold")


@query(
    "t05_interpolation",
    """SELECT core, g AS grid, round(CASE WHEN lo IS NULL THEN hv WHEN hi IS NULL THEN lv WHEN hi=lo THEN lv ELSE lv+(hv-lv)*(g-lo)/(hi-lo) END,6) AS sst FROM (SELECT c.core, g.g,
    (SELECT max(age_kyr) FROM pts p WHERE p.core=c.core AND age_kyr<=g.g) lo, (SELECT min(age_kyr) FROM pts p WHERE p.core=c.core AND age_kyr>=g.g) hi,
    (SELECT arg_max(sst,age_kyr) FROM pts p WHERE p.core=c.core AND age_kyr<=g.g) lv, (SELECT arg_min(sst,age_kyr) FROM pts p WHERE p.core=c.core AND age_kyr>=g.g) hv
    FROM (SELECT DISTINCT core FROM meta) c CROSS JOIN (SELECT unnest(range(0,151,25)) g) g)""".replace(" pts ", " (SELECT core, age_kyr, avg(sst) sst FROM meta GROUP BY ALL) "),
)
def interpolation(d: Domain):
    points = d.meta.groupBy("core", F.col("age_kyr").alias("x")).agg(F.avg("sst").alias("y"))
    grid = d.meta.select("core").distinct().select("core", F.explode(F.sequence(F.lit(0), F.lit(150), F.lit(25))).alias("grid"))
    return interpolate(points, grid, "core").select("core", F.col("grid").cast("long").alias("grid"), F.round("y", 6).alias("sst"))


def interpolate(points: DataFrame, grid: DataFrame, by: str) -> DataFrame:
    """Linear interpolation of (x, y) onto grid points, flat outside the range; one pass over the union in x order."""
    rows = points.select(by, "x", F.struct("x", "y").alias("p"), F.lit(None).cast("int").alias("grid")).unionByName(
        grid.select(by, F.col("grid").cast("double").alias("x"), F.lit(None).cast("struct<x:double,y:double>").alias("p"), "grid")
    )
    w = W(by).orderBy("x", F.col("grid").asc_nulls_first())
    down = W(by).orderBy(F.desc("x"), F.col("grid").asc_nulls_first())
    lo = F.last("p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last("p", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(by, "grid", "x", lo.alias("lo"), hi.alias("hi")).where("grid is not null")
    step = F.col("lo.y") + (F.col("hi.y") - F.col("lo.y")) * F.try_divide(F.col("x") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
    y = F.when(F.col("lo").isNull(), F.col("hi.y")).when(F.col("hi").isNull() | (F.col("hi.x") == F.col("lo.x")), F.col("lo.y")).otherwise(step)
    return rows.select(by, "grid", y.alias("y"))


@query("t06_variance_by_core", "SELECT round(1-sum(ss)/max(tss),6) AS r2 FROM (SELECT sum((mis-m)*(mis-m)) ss, max(t) tss FROM (SELECT mis, core, avg(mis) OVER (PARTITION BY core) m, var_pop(mis) OVER ()*count(*) OVER () t FROM meta) GROUP BY core)")
def variance_by_core(d: Domain):
    groups = d.meta.groupBy("core").agg(n_rows().alias("n"), F.avg("mis").alias("m"), (F.var_pop("mis") * n_rows()).alias("ss"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - grand * grand * F.sum("n")
    return groups.agg(F.round(1 - F.sum("ss") / (F.sum("ss") + between), 6).alias("r2"))


_PHIS = np.linspace(0, 0.95, 20)


#: Variance that is added to every row of its own, and rows that one task of the fit holds.
_NUGGET, _GLS_ROWS = 1e-8, 1 << 19


def _gls_terms(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per phi the sums of squares and products of the taxa of one core, whitened by phi^|age difference| and freed of the core's mean.

    In the order of age the errors are a Markov process seen with a little noise, so a row is whitened by what a filter over the
    rows before it leaves: time and memory grow with the rows, not with their square. All taxa of the group take a step at a time.
    """
    pdf = pdf.sort_values(["taxon", "age"])
    taxa, first, sizes = np.unique(pdf["taxon"].to_numpy(dtype=object), return_index=True, return_counts=True)
    order = np.argsort(-sizes, kind="stable")  # the longest first: those still going are a prefix
    taxa, first, sizes = taxa[order], first[order], sizes[order]
    y, x, age = (pdf[c].to_numpy(float) for c in ("y", "x", "age"))
    centre = lambda v: v - np.repeat([v[i : i + n].mean() for i, n in zip(first, sizes)], sizes)[np.argsort(np.concatenate([np.arange(i, i + n) for i, n in zip(first, sizes)]))]
    x, y = centre(x), centre(y)  # what the mean takes away is free, and constant values are at exactly 0
    shape = (len(_PHIS), len(taxa))
    log_phi = np.log(np.where(_PHIS > 0, _PHIS, 1))[:, None]
    known = np.zeros((3, *shape))  # what the rows so far say of one, x and y
    spread, log_det = np.ones(shape), np.zeros(shape)
    sums = {k: np.zeros(shape) for k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))}
    for t in range(int(sizes[0])):
        on = int(np.searchsorted(-sizes, -t, side="left"))  # taxa with more than t rows
        at = first[:on] + t
        if t:
            gap = (age[at] - age[at - 1]) * log_phi
            keep = np.where(_PHIS[:, None] > 0, np.exp(gap), 0.0)
            lost = np.where(_PHIS[:, None] > 0, -np.expm1(2 * gap), 1.0)
            ahead, p = known[:, :, :on] * keep, spread[:, :on] * keep * keep + lost
        else:
            ahead, p = known[:, :, :on], spread[:, :on]
        total = p + _NUGGET
        left = np.stack([np.ones(on), x[at], y[at]])[:, None, :] - ahead
        known[:, :, :on] = ahead + left * (p / total)
        spread[:, :on] = p * (_NUGGET / total)
        log_det[:, :on] += 0.5 * np.log(total)
        for (i, j), s in sums.items():
            s[:, :on] += left[i] * left[j] / total
    one = sums[0, 0]
    xx, xy, yy = (sums[i, j] - sums[0, i] * sums[0, j] / one for i, j in ((1, 1), (1, 2), (2, 2)))
    n = np.broadcast_to(sizes, shape)
    return pd.DataFrame({"taxon": np.tile(taxa, len(_PHIS)), "phi": np.repeat(_PHIS, len(taxa)), "n": n.ravel(), "xx": xx.ravel(), "xy": xy.ravel(), "yy": yy.ravel(), "log_det": log_det.ravel()})


def exponential_gls(rows: DataFrame, task_rows: int = _GLS_ROWS) -> DataFrame:
    """``(taxon, n, phi, slope, se, t)`` of y ~ x + core from (taxon, core, x, y, age); errors are correlated within a core only.

    phi is the one of a grid with the greatest profile likelihood. The samples of one taxon in one
    core meet in one task, with those of as many other taxa as ``task_rows`` allows; cores meet in sums.
    Rows with a null value are left out. Estimates are null
    without degrees of freedom or where x or y does not vary within any core.
    """
    known = Workspace(rows.sparkSession, "gls").table(rows.dropna(subset=["x", "y", "age"]).select("taxon", "core", "x", "y", "age"), "known")
    most = known.groupBy("core").count().agg(F.max("count")).first()[0] or 0
    spread = max(-(-most // task_rows), 8)
    dealt = known.groupBy("core", F.pmod(F.xxhash64("taxon"), F.lit(spread)).alias("part"))
    terms = dealt.applyInPandas(_gls_terms, "taxon string, phi double, n long, xx double, xy double, yy double, log_det double")
    sums = terms.groupBy("taxon", "phi").agg(*[F.sum(c).alias(c) for c in ("n", "xx", "xy", "yy", "log_det")], (F.sum("n") - n_rows() - 1).alias("free"))
    fitted = (F.col("free") > 0) & (F.col("xx") > 1e-9) & (F.col("yy") > 1e-9)
    rss = F.greatest(F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx"), F.lit(0.0))
    sums = sums.withColumn("rss", F.when(fitted, rss)).withColumn("slope", F.when(fitted, F.col("xy") / F.col("xx")))
    likelihood = -F.col("n") / 2 * F.log(F.greatest("rss", F.lit(1e-300))) - F.col("log_det")
    se = F.sqrt(F.col("rss") / F.col("free") / F.col("xx"))
    best = sums.groupBy("taxon", "n").agg(F.max_by(F.struct(F.when(fitted, F.col("phi")).alias("phi"), "slope", se.alias("se")), F.coalesce(likelihood, F.lit(0.0))).alias("b"))
    return best.select("taxon", "n", "b.phi", "b.slope", "b.se", F.try_divide("b.slope", "b.se").alias("t"))


@query("t07_gls")
def gls(d: Domain):
    return exponential_gls(d.clr_primary.select("taxon", "core", F.col("clr").alias("y"), F.col("mis").alias("x"), F.col("age_kyr").alias("age")))


def benjamini_hochberg(df: DataFrame, p: str = "p") -> DataFrame:
    """Add ``q``; null p-values stay null and do not count.

    The rank of a p-value is a running count over the distinct values in order, and q the least of p * n / rank from the
    largest value down; neither meets in one task.
    """
    ws = Workspace(df.sparkSession, "fdr")
    stored = ws.table(df, "tested")
    steps = stored.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p_")).agg(n_rows().alias("c_"))
    ranked = ordered.running_sums(steps, [F.col("p_")], {"rank_": F.col("c_")}, ws=ws)
    n = stored.agg(F.count(p).alias("m_"))
    raw = ranked.crossJoin(F.broadcast(n)).withColumn("raw_", F.col("p_") * F.col("m_") / F.col("rank_"))
    least = ordered.running_least(raw, [F.desc("p_")], {"least_": F.col("raw_")}, ws=ws).select("p_", F.least(F.lit(1.0), "least_").alias("q"))
    return stored.join(least, F.col(p) == F.col("p_"), "left").drop("p_")


@query(
    "t08_fdr",
    "SELECT label, round(least(1.0,min(p*m/r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)),8) AS q FROM (SELECT label, p, count(*) OVER () m, row_number() OVER (ORDER BY p) r FROM (SELECT label, (label+1)/1000.0::DOUBLE p FROM samples))",
)
def fdr(d: Domain):
    return benjamini_hochberg(d.samples.select("label", ((F.col("label") + 1) / 1000.0).alias("p"))).select("label", F.round("q", 8).alias("q"))


@F.pandas_udf(T.DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, e: pd.Series) -> pd.Series:
    """Two-sided p of a 2x2 table: the mass of tables no likelier than the one seen."""

    def p(a: int, b: int, c: int, e: int) -> float:
        r, k, n = a + b, a + c, a + b + c + e
        choose = lambda x, y: math.lgamma(x + 1) - math.lgamma(y + 1) - math.lgamma(x - y + 1)
        logs = [choose(k, i) + choose(n - k, r - i) - choose(n, r) for i in range(max(0, r - (n - k)), min(r, k) + 1)]
        seen = choose(k, a) + choose(n - k, r - a) - choose(n, r)
        return min(1.0, sum(math.exp(x) for x in logs if x <= seen + 1e-7))

    return pd.Series([p(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, e)])


@query(
    "t09_fisher",
    """, t AS (SELECT taxon, count(*) FILTER (WHERE mis>4 AND abundance>0) AS a, count(*) FILTER (WHERE mis>4 AND NOT abundance>0) AS b, count(*) FILTER (WHERE NOT mis>4 AND abundance>0) AS c, count(*) FILTER (WHERE NOT mis>4 AND NOT abundance>0) AS e FROM clr5 GROUP BY taxon),
    u AS (SELECT *, a+b AS r, a+c AS k, a+b+c+e AS n FROM t), l AS (SELECT *, unnest(range(greatest(0,r-(n-k)), least(r,k)+1)) AS i FROM u),
    g AS (SELECT taxon, a, b, c, e, i, lgamma(k+1)-lgamma(i+1)-lgamma(k-i+1)+lgamma(n-k+1)-lgamma(r-i+1)-lgamma(n-k-r+i+1)-lgamma(n+1)+lgamma(r+1)+lgamma(n-r+1) AS x FROM l),
    p AS (SELECT taxon, a, b, c, e, least(1.0,sum(exp(x)) FILTER (WHERE x<=seen+1e-7)) AS p FROM (SELECT *, max(CASE WHEN i=a THEN x END) OVER (PARTITION BY taxon) AS seen FROM g) GROUP BY ALL),
    s AS (SELECT p, count(*) AS m FROM (SELECT round(p,9) AS p FROM p) GROUP BY p), f AS (SELECT p, p*(SELECT count(*) FROM t)/sum(m) OVER (ORDER BY p) AS raw FROM s), q AS (SELECT p, least(1.0,min(raw) OVER (ORDER BY p DESC)) AS q FROM f)
    SELECT taxon, a, b, c, e, q.p, round(log2((a+0.5)/(c+0.5)),6) AS log2fc, round(q.q,8) AS q, CASE WHEN round(q.q,8)<0.1 THEN CASE WHEN log2((a+0.5)/(c+0.5))>0 THEN 'cold' ELSE 'warm' END ELSE 'neutral' END AS class FROM p JOIN q ON q.p=round(p.p,9)""",
)
def fisher(d: Domain):
    cold = F.col("mis") > 4
    hit = F.col("abundance") > 0
    counts = d.clr_primary.groupBy("taxon").agg(*[F.count_if(x).alias(n) for n, x in (("a", cold & hit), ("b", cold & ~hit), ("c", ~cold & hit), ("e", ~cold & ~hit))])
    # Nine digits: equal tables reach equal values by different sums.
    tested = counts.withColumn("p", F.round(fisher_exact("a", "b", "c", "e"), 9)).withColumn("log2fc", F.round(F.log2((F.col("a") + 0.5) / (F.col("c") + 0.5)), 6))
    return benjamini_hochberg(tested).withColumn("q", F.round("q", 8)).withColumn("class", F.when(F.col("q") < 0.1, F.when(F.col("log2fc") > 0, "cold").otherwise("warm")).otherwise("neutral"))


@query(
    "t10_kruskal_wallis",
    """SELECT round((12.0/(n*(n+1))*sum(s*s/k)-3*(n+1))/(1-coalesce(max(ties),0)/(n*n*n-n)),6) AS h, count(*)-1 AS df FROM (SELECT core, sum(r) s, count(*) k, max(n)::DOUBLE n, max(ties) ties FROM (SELECT core, rank() OVER (ORDER BY mis)+(count(*) OVER (PARTITION BY mis)-1)/2.0 r, count(*) OVER () n,
    (SELECT sum(c*c*c-c)::DOUBLE FROM (SELECT count(*) c FROM meta GROUP BY mis)) ties FROM meta) GROUP BY core) GROUP BY n""",
)
def kruskal(d: Domain):
    by = d.meta.groupBy("mis").agg(n_rows().alias("c"))
    below = F.coalesce(F.sum("c").over(Window.orderBy("mis").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by.select("mis", (below + (F.col("c") + 1) / 2.0).alias("r"), "c")
    ties = by.agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    g = d.meta.join(ranks, "mis").groupBy("core").agg((F.sum("r") * F.sum("r") / n_rows()).alias("s"))
    x = g.agg(F.sum("s").alias("s"), (n_rows() - 1).alias("df")).crossJoin(ties)
    n = F.col("n")
    return x.select(F.round((12.0 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n)), 6).alias("h"), "df")


@query("t11_residuals", "SELECT label, round(sst-(a+b*mis),6) AS residual FROM meta, (SELECT regr_intercept(sst,mis) a, regr_slope(sst,mis) b FROM meta)")
def residuals(d: Domain):
    line = d.meta.agg(F.regr_intercept("sst", "mis").alias("a"), F.regr_slope("sst", "mis").alias("b"))
    return d.meta.crossJoin(F.broadcast(line)).select("label", F.round(F.col("sst") - (F.col("a") + F.col("b") * F.col("mis")), 6).alias("residual"))


@query(
    "t12_richness",
    "SELECT label, count(*) AS observed, round(count(*)+CASE WHEN f2>0 THEN f1*f1/(2.0*f2) ELSE f1*(f1-1)/2.0 END,6) AS chao1, round(1-f1*1.0/n,6) AS coverage FROM (SELECT label, taxon, count(*) FILTER (WHERE n_records=1) OVER (PARTITION BY label) f1, count(*) FILTER (WHERE n_records=2) OVER (PARTITION BY label) f2, sum(n_records) OVER (PARTITION BY label) n FROM totals) GROUP BY label,f1,f2,n",
)
def richness(d: Domain):
    g = d.totals.groupBy("label").agg(n_rows().alias("observed"), F.count_if(F.col("n_records") == 1).alias("f1"), F.count_if(F.col("n_records") == 2).alias("f2"), F.sum("n_records").alias("n"))
    f1, f2 = F.col("f1"), F.col("f2")
    chao = F.col("observed") + F.when(f2 > 0, f1 * f1 / (2.0 * f2)).otherwise(f1 * (f1 - 1) / 2.0)
    return g.select("label", "observed", F.round(chao, 6).alias("chao1"), F.round(1 - f1 / F.col("n"), 6).alias("coverage"))


@F.pandas_udf(T.DoubleType())
def rarefied(counts: pd.Series, depth: pd.Series) -> pd.Series:
    """Expected number of taxa in a draw of ``depth`` records without replacement."""

    def expected(c: np.ndarray, m: int) -> float:
        n = int(c.sum())
        choose = lambda x: math.lgamma(x + 1) - math.lgamma(m + 1) - math.lgamma(x - m + 1) if x >= m else -math.inf
        return float(sum(1 - math.exp(choose(n - int(k)) - choose(n)) for k in c)) if m <= n else float(len(c))

    return pd.Series([expected(np.asarray(c), int(m)) for c, m in zip(counts, depth)])


@query("t12_rarefaction")
def rarefaction(d: Domain):
    g = d.totals.groupBy("label").agg(F.collect_list("n_records").alias("c"), F.sum("n_records").alias("n"))
    return g.select("label", "n", rarefied("c", F.greatest(F.lit(1), F.floor(F.col("n") * 0.8))).alias("at_80"))


@query(
    "t13_size_factors",
    "SELECT label, round(median(ln(n_reads)-g),6) AS log_factor FROM (SELECT label, n_reads, avg(ln(n_reads)) OVER (PARTITION BY taxon) g FROM totals WHERE n_reads>0) GROUP BY 1",
)
def size_factors(d: Domain):
    logged = F.log("n_reads")
    t = d.totals.where("n_reads > 0").select("label", (logged - F.avg(logged).over(W("taxon"))).alias("x"))
    return t.groupBy("label").agg(F.round(F.median("x"), 6).alias("log_factor"))


@query(
    "t14_reference_taxon",
    "SELECT taxon, round(s,6) AS score FROM (SELECT taxon, abs(corr(clr,age_kyr))+abs(corr(clr,sst)) s FROM clr5 GROUP BY 1 HAVING avg((abundance>0)::INT)>=0.15) ORDER BY round(s,6), taxon LIMIT 10",
)
def reference_taxon(d: Domain):
    g = d.clr_primary.groupBy("taxon").agg((F.abs(C.safe_corr("clr", "age_kyr")) + F.abs(C.safe_corr("clr", "sst"))).alias("s"), F.avg((F.col("abundance") > 0).cast("int")).alias("p"))
    return g.where("p >= 0.15").select("taxon", F.round("s", 6).alias("score")).orderBy("score", "taxon").limit(10)


@query(
    "t15_potential",
    "SELECT label, round(sum((clr-lo+0.01)*cap),4) AS emp FROM (SELECT label, taxon, clr, min(clr) OVER () lo FROM clr5) JOIN (SELECT p_brand||'/'||p_type taxon, sum(p_size/50.0*100) cap FROM part GROUP BY 1) USING(taxon) GROUP BY 1",
)
def potential(d: Domain):
    capacity = d.table("part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("taxon")).agg(F.sum(F.col("p_size") / 50.0 * 100).alias("cap"))
    low = d.clr_primary.agg(F.min("clr").alias("lo"))
    x = d.clr_primary.join(capacity, "taxon").crossJoin(F.broadcast(low))
    return x.groupBy("label").agg(F.round(F.sum((F.col("clr") - F.col("lo") + 0.01) * F.col("cap")), 4).alias("emp"))


@query(
    "t16_sugar_acid",
    "SELECT label, round(sum(n_reads*ratio)/sum(n_reads),6) AS sap FROM totals JOIN (SELECT p_brand||'/'||p_type taxon, coalesce(sum(p_size) FILTER (WHERE p_size>25)/greatest(coalesce(sum(p_size) FILTER (WHERE p_size<=25),0),0.01),1) ratio FROM part GROUP BY 1) USING(taxon) GROUP BY 1",
)
def sugar_acid(d: Domain):
    part = d.table("part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("taxon")).agg(F.sum(F.when(F.col("p_size") > 25, F.col("p_size"))).alias("s"), F.sum(F.when(F.col("p_size") <= 25, F.col("p_size"))).alias("a"))
    ratio = part.select("taxon", F.coalesce(F.col("s") / F.greatest(F.coalesce("a", F.lit(0)), F.lit(0.01)), F.lit(1.0)).alias("ratio"))
    x = d.totals.join(ratio, "taxon").groupBy("label")
    return x.agg(F.round(F.sum(F.col("n_reads") * F.col("ratio")) / F.sum("n_reads"), 6).alias("sap"))


@query(
    "t17_redox",
    "SELECT label, round(e,6) AS e0, CASE WHEN e>60 THEN 'oxic' WHEN e>40 THEN 'suboxic' ELSE 'anoxic' END AS class FROM (SELECT label, sum(n_reads*e)/sum(n_reads) e FROM totals JOIN (SELECT p_brand||'/'||p_type taxon, avg(p_size)*2 e FROM part GROUP BY 1) USING(taxon) GROUP BY 1)",
)
def redox(d: Domain):
    e = d.table("part").groupBy(F.concat_ws("/", "p_brand", "p_type").alias("taxon")).agg((F.avg("p_size") * 2).alias("e"))
    x = d.totals.join(e, "taxon").groupBy("label").agg((F.sum(F.col("n_reads") * F.col("e")) / F.sum("n_reads")).alias("e"))
    return x.select("label", F.round("e", 6).alias("e0"), F.when(F.col("e") > 60, "oxic").when(F.col("e") > 40, "suboxic").otherwise("anoxic").alias("class"))


@query("t19_sign_alignment", "SELECT label, round(CASE WHEN r<0 THEN -mis ELSE mis END,6) AS aligned FROM meta, (SELECT corr(mis,age_kyr) r FROM meta)")
def sign_alignment(d: Domain):
    r = d.meta.agg(C.safe_corr("mis", "age_kyr").alias("r"))
    return d.meta.crossJoin(F.broadcast(r)).select("label", F.round(F.when(F.col("r") < 0, -F.col("mis")).otherwise(F.col("mis")), 6).alias("aligned"))


@query("t20_component_depth")
def component_depth(d: Domain):
    scores = pca(d).join(d.totals.groupBy(F.col("label").alias("entity")).agg(F.log10(F.sum("n_reads") + 1).alias("depth")), "entity")
    return scores.groupBy("threshold", "component").agg(C.safe_corr("score", "depth").alias("r"))
