"""Aggregations, windows, ranking and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.operators import abundance, ordered
from varve.functions.columns import n_rows
from varve.plans.base import query
from varve.sources.domain import Domain

W = Window.partitionBy


@query("a01_record_totals", "SELECT taxon, label, n_reads, abundance, round(reference_length,4) AS reference_length, n_records FROM totals")
def record_totals(d: Domain):
    return d.totals.withColumn("reference_length", F.round("reference_length", 4))


@query("a02_conditional_count", "SELECT label, count(*) FILTER (WHERE abundance>0) AS present FROM totals GROUP BY label")
def conditional_count(d: Domain):
    return d.totals.groupBy("label").agg(F.count_if(F.col("abundance") > 0).alias("present"))


@query("a03_prevalence", "SELECT threshold, taxon, n_samples FROM prevalent")
def prevalence(d: Domain):
    return d.prevalent


@query("a04_core_summary", "SELECT core, count(*) AS samples, round(min(age_kyr),6) AS lo, round(max(age_kyr),6) AS hi, round(avg(age_kyr),6) AS mean_age, round(stddev_samp(sst),6) AS sd_sst FROM meta GROUP BY core")
def core_summary(d: Domain):
    r = lambda c: F.round(c, 6)
    return d.meta.groupBy("core").agg(
        n_rows().alias("samples"), r(F.min("age_kyr")).alias("lo"), r(F.max("age_kyr")).alias("hi"), r(F.avg("age_kyr")).alias("mean_age"), r(F.stddev_samp("sst")).alias("sd_sst")
    )


@query(
    "a05_taxon_profile",
    "SELECT core, taxon, round(avg(clr),6) AS mean_clr, round(stddev_samp(clr),6) AS sd_clr, round(avg(abs(clr)),6) AS mean_abs_clr, round(max(abs(clr)),6) AS max_abs_clr, round(avg((abundance>0)::INT),6) AS prevalence, round(avg(abundance),6) AS mean_abundance FROM clr5 GROUP BY ALL",
)
def taxon_profile(d: Domain):
    p = abundance.taxon_profile(d.clr_primary, ["core", "taxon"])
    return p.select("core", "taxon", *[F.round(c, 6).alias(c) for c in p.columns if c not in ("core", "taxon")])


@query("a06_count_distinct", "SELECT functional_group, count(DISTINCT phylum) AS phyla, count(DISTINCT taxon) AS n_taxa FROM taxa GROUP BY 1")
def count_distinct(d: Domain):
    return d.taxa.groupBy("functional_group").agg(F.countDistinct("phylum").alias("phyla"), F.countDistinct("taxon").alias("n_taxa"))


@query("a07_quantiles", "SELECT taxon, round(median(n_reads),6) AS med, round(quantile_cont(n_reads,0.05),6) AS p05, round(quantile_cont(n_reads,0.95),6) AS p95 FROM totals GROUP BY 1")
def quantiles(d: Domain):
    q = F.percentile("n_reads", F.array(F.lit(0.05), F.lit(0.95)))
    g = d.totals.groupBy("taxon").agg(F.median("n_reads").alias("med"), q.alias("q"))
    return g.select("taxon", F.round("med", 6).alias("med"), F.round(F.col("q")[0], 6).alias("p05"), F.round(F.col("q")[1], 6).alias("p95"))


@query(
    "a08_weighted_moments",
    "SELECT taxon, round(mu,6) AS mu, round(sum(abundance*(mis-mu)*(mis-mu))/sum(abundance),6) AS var FROM (SELECT *, sum(abundance*mis) OVER (PARTITION BY taxon)/sum(abundance) OVER (PARTITION BY taxon) AS mu FROM totals JOIN meta USING(label) WHERE abundance>0) GROUP BY ALL",
)
def weighted(d: Domain):
    t = d.totals.join(d.meta.select("label", "mis"), "label").where("abundance > 0")
    mu = F.sum(F.col("abundance") * F.col("mis")).over(W("taxon")) / F.sum("abundance").over(W("taxon"))
    t = t.withColumn("mu", mu)
    var = F.sum(F.col("abundance") * (F.col("mis") - F.col("mu")) * (F.col("mis") - F.col("mu"))) / F.sum("abundance")
    return t.groupBy("taxon", "mu").agg(F.round(var, 6).alias("var")).select("taxon", F.round("mu", 6).alias("mu"), "var")


@query("a09_argmax", "SELECT label, taxon FROM (SELECT label, taxon, row_number() OVER (PARTITION BY label ORDER BY n_reads DESC, taxon) rn FROM totals) WHERE rn=1")
def argmax(d: Domain):
    return d.totals.withColumn("rn", F.row_number().over(W("label").orderBy(F.desc("n_reads"), "taxon"))).where("rn = 1").select("label", "taxon")


@query("a10_mode", "SELECT p_brand, p_type FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) rn FROM (SELECT p_brand, p_type, count(*) n FROM part GROUP BY 1,2)) WHERE rn=1")
def mode(d: Domain):
    n = d.table("part").groupBy("p_brand", "p_type").agg(n_rows().alias("n"))
    return n.withColumn("rn", F.row_number().over(W("p_brand").orderBy(F.desc("n"), "p_type"))).where("rn = 1").select("p_brand", "p_type")


@query(
    "a11_frequency_text",
    "SELECT phylum, string_agg(functional_group||' ('||n||')','; ' ORDER BY n DESC, functional_group) AS top FROM (SELECT *, row_number() OVER (PARTITION BY phylum ORDER BY n DESC, functional_group) rn FROM (SELECT p_brand AS phylum, p_type AS functional_group, count(*) n FROM part GROUP BY 1,2)) WHERE rn<=3 GROUP BY phylum",
)
def frequency_text(d: Domain):
    n = d.table("part").groupBy(F.col("p_brand").alias("phylum"), "p_type").agg(n_rows().alias("n"))
    top = n.withColumn("rn", F.row_number().over(W("phylum").orderBy(F.desc("n"), "p_type"))).where("rn <= 3")
    cell = F.struct("rn", F.format_string("%s (%d)", "p_type", "n").alias("v"))
    return top.groupBy("phylum").agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["v"]), "; ").alias("top"))


@query("a12_conditional_sums", "SELECT label, sum(n_reads) FILTER (WHERE abundance>0) AS hit, coalesce(sum(CASE WHEN abundance=0 THEN n_reads END),0) AS miss FROM totals GROUP BY 1")
def conditional_sums(d: Domain):
    s = lambda c: F.sum(F.when(c, F.col("n_reads")))
    return d.totals.groupBy("label").agg(s(F.col("abundance") > 0).alias("hit"), F.coalesce(s(F.col("abundance") == 0), F.lit(0.0)).alias("miss"))


@query("a13_share", "SELECT taxon, label, round(n_reads/sum(n_reads) OVER (PARTITION BY label),8) AS share FROM totals")
def share(d: Domain):
    return d.totals.select("taxon", "label", F.round(F.col("n_reads") / F.sum("n_reads").over(W("label")), 8).alias("share"))


@query("a14_minmax", "SELECT label, round((sst-min(sst) OVER ())/(max(sst) OVER ()-min(sst) OVER ()),6) AS scaled FROM samples")
def minmax(d: Domain):
    ends = d.samples.agg(F.min("sst").alias("lo"), F.max("sst").alias("hi"))
    s = d.samples.crossJoin(F.broadcast(ends))
    return s.select("label", F.round(F.when(F.col("hi") == F.col("lo"), 0.0).otherwise((F.col("sst") - F.col("lo")) / (F.col("hi") - F.col("lo"))), 6).alias("scaled"))


@query("a15_composite_score", "SELECT label, round(0.6*sst+0.2*mis+0.2*age_kyr,6) AS score FROM samples")
def composite(d: Domain):
    return d.samples.select("label", F.round(0.6 * F.col("sst") + 0.2 * F.col("mis") + 0.2 * F.col("age_kyr"), 6).alias("score"))


@query("a16_row_mean", "SELECT label, round(CASE WHEN core='ASIA' THEN sst ELSE (sst+mis)/2 END,6) AS m, greatest(sst,mis) AS hi, least(sst,mis) AS lo FROM samples")
def row_mean(d: Domain):
    s = d.samples.withColumn("x", F.when(F.col("core") != "ASIA", F.col("mis")))
    return s.select("label", F.round(C.row_mean("sst", "x"), 6).alias("m"), F.greatest("sst", "mis").alias("hi"), F.least("sst", "mis").alias("lo"))


@query("a17_confusion", "SELECT quality, toxic, n, round(n/sum(n) OVER (PARTITION BY quality),6) AS purity FROM (SELECT quality, toxic, count(*) n FROM labels GROUP BY ALL)")
def confusion(d: Domain):
    n = d.table("labels").groupBy("quality", "toxic").agg(n_rows().alias("n"))
    return n.withColumn("purity", F.round(F.col("n") / F.sum("n").over(W("quality")), 6))


@query("a18_agreement", "SELECT round(avg((quality=toxic)::INT),6) AS agreement FROM labels")
def agreement(d: Domain):
    return d.table("labels").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("agreement"))


@query("a19_two_sided_degree", "SELECT core, taxon, degree, round(strength,6) AS strength FROM degrees")
def two_sided(d: Domain):
    from varve.operators.graphs import degrees

    return degrees(d.edges).withColumn("strength", F.round("strength", 6))


@query(
    "a20_bin_difference",
    "SELECT taxon, round(coalesce(avg(abundance) FILTER (WHERE mis<=4),0),6) AS low, round(coalesce(avg(abundance) FILTER (WHERE mis>4),0),6) AS high, round(coalesce(avg(abundance) FILTER (WHERE mis>4),0)-coalesce(avg(abundance) FILTER (WHERE mis<=4),0),6) AS delta FROM totals JOIN meta USING(label) GROUP BY 1",
)
def bin_difference(d: Domain):
    t = d.totals.join(d.meta.select("label", "mis"), "label")
    m = lambda c: F.coalesce(F.avg(F.when(c, F.col("abundance"))), F.lit(0.0))
    g = t.groupBy("taxon").agg(m(F.col("mis") <= 4).alias("a"), m(F.col("mis") > 4).alias("b"))
    return g.select("taxon", F.round("a", 6).alias("low"), F.round("b", 6).alias("high"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query(
    "a21_diversity",
    "SELECT label, round(-sum(p*ln(p)),6) AS entropy, round(-sum(p*ln(p))/nullif(ln(count(*)),0),6) AS evenness, round(1/sum(p*p),6) AS balance FROM (SELECT label, n_reads/sum(n_reads) OVER (PARTITION BY label) p FROM totals) GROUP BY 1",
)
def diversity(d: Domain):
    s = d.totals.select("label", (F.col("n_reads") / F.sum("n_reads").over(W("label"))).alias("p"))
    g = s.groupBy("label").agg(C.entropy("p").alias("h"), n_rows().alias("n"), (1 / F.sum(F.col("p") * F.col("p"))).alias("b"))
    return g.select("label", F.round("h", 6).alias("entropy"), F.round(F.try_divide("h", F.log("n")), 6).alias("evenness"), F.round("b", 6).alias("balance"))


@query(
    "a22_gini",
    "SELECT label, round(2*sum(r*x)/(count(*)*sum(x))-(count(*)+1.0)/count(*),6) AS gini FROM (SELECT label, n_reads x, row_number() OVER (PARTITION BY label ORDER BY n_reads, taxon) r FROM totals) GROUP BY 1",
)
def gini(d: Domain):
    r = d.totals.select("label", F.col("n_reads").alias("x"), F.row_number().over(W("label").orderBy("n_reads", "taxon")).alias("r"))
    g = 2 * F.sum(F.col("r") * F.col("x")) / (n_rows() * F.sum("x")) - (n_rows() + 1.0) / n_rows()
    return r.groupBy("label").agg(F.round(g, 6).alias("gini"))


@query(
    "a23_top_share",
    """SELECT label, round(sum(x) FILTER (WHERE rn<=5)/sum(x),6) AS top5, min(rn) FILTER (WHERE cum>=0.5*tot) AS half_rank FROM (SELECT label, n_reads x, row_number() OVER w rn, sum(n_reads) OVER (PARTITION BY label ORDER BY n_reads DESC, taxon ROWS UNBOUNDED PRECEDING) cum,
    sum(n_reads) OVER (PARTITION BY label) tot FROM totals WINDOW w AS (PARTITION BY label ORDER BY n_reads DESC, taxon)) GROUP BY 1""",
)
def top_share(d: Domain):
    w = W("label").orderBy(F.desc("n_reads"), "taxon")
    t = d.totals.select(
        "label", F.col("n_reads").alias("x"), F.row_number().over(w).cast("long").alias("rn"), F.sum("n_reads").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.sum("n_reads").over(W("label")).alias("tot")
    )
    return t.groupBy("label").agg(
        F.round(F.sum(F.when(F.col("rn") <= 5, F.col("x"))) / F.sum("x"), 6).alias("top5"), F.min(F.when(F.col("cum") >= 0.5 * F.col("tot"), F.col("rn"))).alias("half_rank")
    )


@query(
    "a24_enrichment",
    "SELECT core, b AS bin, round(n*tot*1.0/(ncore*nbin),6) AS ratio FROM (SELECT core, (floor(age_kyr/50)*50)::BIGINT b, count(*) n, sum(count(*)) OVER () tot, sum(count(*)) OVER (PARTITION BY core) ncore, sum(count(*)) OVER (PARTITION BY floor(age_kyr/50)*50) nbin FROM meta GROUP BY core, floor(age_kyr/50)*50)",
)
def enrichment(d: Domain):
    n = d.meta.groupBy("core", (F.floor(F.col("age_kyr") / 50) * 50).alias("bin")).agg(n_rows().alias("n"))
    total = n.agg(F.sum("n").alias("tot"))
    n = n.withColumns({"a": F.sum("n").over(W("core")), "b": F.sum("n").over(W("bin"))}).crossJoin(F.broadcast(total))
    return n.select("core", "bin", F.round(F.col("n") * F.col("tot") / (F.col("a") * F.col("b")), 6).alias("ratio"))


@query(
    "a25_eta_squared",
    "SELECT round(sum((m-g)*(m-g))/sum((sst-g)*(sst-g)),6) AS eta2 FROM (SELECT sst, avg(sst) OVER (PARTITION BY core) m, avg(sst) OVER () g FROM meta)",
)
def eta_squared(d: Domain):
    g = d.meta.agg(F.avg("sst").alias("g"))
    s = d.meta.withColumn("m", F.avg("sst").over(W("core"))).crossJoin(F.broadcast(g))
    sq = lambda a: F.sum((F.col(a) - F.col("g")) * (F.col(a) - F.col("g")))
    return s.agg(F.round(sq("m") / sq("sst"), 6).alias("eta2"))


@query("a26_variation", "SELECT core, round(stddev_samp(mis)/avg(mis),6) AS cv FROM meta GROUP BY 1")
def variation(d: Domain):
    return d.meta.groupBy("core").agg(F.round(F.stddev_samp("mis") / F.avg("mis"), 6).alias("cv"))


@query(
    "a27_funnel",
    "SELECT step, n::BIGINT AS n, round(100.0*n/tot,4) AS pct FROM (SELECT unnest(['young','warm','known']) step, unnest([count(*) FILTER (WHERE age_kyr<=150), count(*) FILTER (WHERE sst>=5), count(*) FILTER (WHERE core<>'MIDDLE EAST')]) n, count(*) tot FROM samples)",
)
def funnel(d: Domain):
    tests = {"young": F.col("age_kyr") <= 150, "warm": F.col("sst") >= 5, "known": F.col("core") != "MIDDLE EAST"}
    one = d.samples.agg(n_rows().alias("tot"), *[F.count_if(c).alias(k) for k, c in tests.items()])
    return one.unpivot("tot", list(tests), "step", "n").select("step", "n", F.round(100.0 * F.col("n") / F.col("tot"), 4).alias("pct"))


@query(
    "a28_kappa",
    "SELECT round(po,6) AS accuracy, round((po-pe)/(1-pe),6) AS kappa FROM (SELECT avg((quality=toxic)::INT) po, avg(quality)*avg(toxic)+(1-avg(quality))*(1-avg(toxic)) pe FROM labels)",
)
def kappa(d: Domain):
    q, t = F.avg("quality"), F.avg("toxic")
    s = d.table("labels").agg(F.avg((F.col("quality") == F.col("toxic")).cast("int")).alias("po"), (q * t + (1 - q) * (1 - t)).alias("pe"))
    return s.select(F.round("po", 6).alias("accuracy"), F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 6).alias("kappa"))


@query(
    "a29_auc",
    """, x AS (SELECT n_chars, sum(quality) AS p, sum(1-quality) AS q FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL GROUP BY n_chars),
    run AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM x WINDOW w AS (ORDER BY n_chars DESC))
    SELECT round(sum(q*(cp-p+p/2.0))/nullif(sum(p)*sum(q),0),6) AS auc, round(sum(p*cp*1.0/(cp+cq))/nullif(sum(p),0),6) AS average_precision FROM run""",
)
def auc(d: Domain):
    """Area under the curve and average precision of the length of a document as a sign of quality."""
    scored = d.table("labels").join(d.table("documents").select("doc_id", "n_chars"), "doc_id")
    found = ordered.ranking_quality(scored, label="quality", score="n_chars")
    return found.select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query("a30_all_correlations", "SELECT 'mis' AS a, 'sst' AS b, round(corr(mis,sst),6) AS r FROM meta UNION ALL SELECT 'age_kyr','mis',round(corr(age_kyr,mis),6) FROM meta UNION ALL SELECT 'age_kyr','sst',round(corr(age_kyr,sst),6) FROM meta")
def all_correlations(d: Domain):
    names = ["age_kyr", "mis", "sst"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = d.meta.agg(*[C.safe_corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("r")) for a, b in pairs])).alias("x"))
    return long.select("x.*")


@query(
    "a31_occupancy",
    "SELECT taxon, count(*) FILTER (WHERE abundance>0) AS present, sum(abundance) AS total, max(abundance) AS top, round(avg(abundance) FILTER (WHERE abundance>0),6) AS mean_present FROM totals GROUP BY 1",
)
def occupancy(d: Domain):
    return d.totals.groupBy("taxon").agg(
        F.count_if(F.col("abundance") > 0).alias("present"), F.sum("abundance").alias("total"), F.max("abundance").alias("top"), F.round(F.avg(F.when(F.col("abundance") > 0, F.col("abundance"))), 6).alias("mean_present")
    )


@query(
    "a32_composition",
    "SELECT label%3 AS state, coalesce(g,'Unknown') AS functional_group, count(*) AS n FROM totals LEFT JOIN (SELECT taxon, functional_group g FROM taxa WHERE functional_group<>'SMALL') USING(taxon) GROUP BY ALL",
)
def composition(d: Domain):
    t = d.totals.join(d.taxa.where("functional_group <> 'SMALL'").select("taxon", "functional_group"), "taxon", "left")
    return t.groupBy((F.col("label") % 3).alias("state"), F.coalesce("functional_group", F.lit("Unknown")).alias("functional_group")).agg(n_rows().alias("n"))


@query("a33_many_to_one", "SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1 HAVING count(DISTINCT p_type)>1")
def many_to_one(d: Domain):
    g = d.table("part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("t")).where(F.size("t") > 1)
    return g.select("p_brand", F.array_join("t", ",").alias("types"))


@query(
    "a34_overlapping_subsets",
    "SELECT 'all' AS subset, count(*) AS n, round(avg(sst),6) AS m FROM samples UNION ALL SELECT 'asia',count(*),round(avg(sst),6) FROM samples WHERE core='ASIA' UNION ALL SELECT 'not_asia',count(*),round(avg(sst),6) FROM samples WHERE core<>'ASIA'",
)
def overlapping(d: Domain):
    tags = F.array(F.lit("all"), F.when(F.col("core") == "ASIA", "asia").otherwise("not_asia"))
    return d.samples.select(F.explode(tags).alias("subset"), "sst").groupBy("subset").agg(n_rows().alias("n"), F.round(F.avg("sst"), 6).alias("m"))


@query("w01_top_per_group", "SELECT label, taxon, rn FROM (SELECT label, taxon, row_number() OVER (PARTITION BY label ORDER BY n_reads DESC, taxon)::INT rn FROM totals) WHERE rn<=5")
def top_per_group(d: Domain):
    rn = F.row_number().over(W("label").orderBy(F.desc("n_reads"), "taxon"))
    return d.totals.withColumn("rn", rn).where("rn <= 5").select("label", "taxon", "rn")


@query("w02_global_rank", "SELECT taxon, row_number() OVER (ORDER BY s DESC, taxon)::INT AS rank FROM (SELECT taxon, sum(n_reads) s FROM totals GROUP BY 1)")
def global_rank(d: Domain):
    s = d.totals.groupBy("taxon").agg(F.sum("n_reads").alias("s"))
    return ordered.positions(s, [F.desc("s"), F.col("taxon")], name="rank").select("taxon", (F.col("rank") + 1).cast("int").alias("rank"))


@query("w03_average_rank", "SELECT taxon, label, rank() OVER (PARTITION BY label ORDER BY n_reads)+(count(*) OVER (PARTITION BY label, n_reads)-1)/2.0::DOUBLE AS r FROM totals")
def average_ranks(d: Domain):
    return d.totals.select("taxon", "label", C.average_rank("n_reads", ["label"]).alias("r"))


@query("w04_group_total", "SELECT taxon, label, sum(n_reads) OVER (PARTITION BY taxon) AS total FROM totals")
def group_total(d: Domain):
    return d.totals.select("taxon", "label", F.sum("n_reads").over(W("taxon")).alias("total"))


@query("w05_centre", "SELECT label, core, round(sst-avg(sst) OVER (PARTITION BY core),6) AS centred FROM meta")
def centre(d: Domain):
    return d.meta.select("label", "core", F.round(F.col("sst") - F.avg("sst").over(W("core")), 6).alias("centred"))


@query("w06_clr", "SELECT threshold, taxon, label, round(clr,6) AS clr FROM clr")
def clr(d: Domain):
    return d.clr.select("threshold", "taxon", "label", F.round("clr", 6).alias("clr"))


@query(
    "w07_taxon_centred",
    "SELECT taxon, label, round(ln(abundance+0.5)-avg(ln(abundance+0.5)) OVER (PARTITION BY taxon),6) AS taxon_centred, round(ln(abundance+0.5)-ln(ref+0.5),6) AS alr FROM (SELECT *, max(CASE WHEN taxon=(SELECT min(taxon) FROM prevalent WHERE threshold=5) THEN abundance END) OVER (PARTITION BY label) AS ref FROM cells WHERE threshold=5)",
)
def taxon_centred(d: Domain):
    c = d.cells.where("threshold = 5")
    first = d.prevalent.where("threshold = 5").agg(F.min("taxon").alias("taxon"))
    ref = c.join(F.broadcast(first), "taxon").select("label", F.col("abundance").alias("ref"))
    logged = F.log(F.col("abundance") + 0.5)
    c = c.join(ref, "label")
    return c.select("taxon", "label", F.round(logged - F.avg(logged).over(W("taxon")), 6).alias("taxon_centred"), F.round(logged - F.log(F.col("ref") + 0.5), 6).alias("alr"))


@query("w08_zscore", "SELECT label, core, round(coalesce((sst-avg(sst) OVER w)/nullif(stddev_samp(sst) OVER w,0),0),6) AS z FROM meta WINDOW w AS (PARTITION BY core)")
def zscore(d: Domain):
    return d.meta.select("label", "core", F.round(C.zscore(F.col("sst"), W("core")), 6).alias("z"))


@query("w09_lead", "SELECT label, round(coalesce(lead(age_kyr) OVER (PARTITION BY core ORDER BY age_kyr,label),age_kyr+1),6) AS until FROM meta")
def lead(d: Domain):
    nxt = F.lead("age_kyr").over(W("core").orderBy("age_kyr", "label"))
    return d.meta.select("label", F.round(F.coalesce(nxt, F.col("age_kyr") + 1), 6).alias("until"))


@query("w10_spacing", "SELECT core, round(median(s),6) AS spacing FROM (SELECT core, age_kyr-lag(age_kyr) OVER (PARTITION BY core ORDER BY age_kyr,label) s FROM meta) GROUP BY 1")
def spacing(d: Domain):
    s = F.col("age_kyr") - F.lag("age_kyr").over(W("core").orderBy("age_kyr", "label"))
    return d.meta.select("core", s.alias("s")).groupBy("core").agg(F.round(F.median("s"), 6).alias("spacing"))


@query("w11_cumulative", "SELECT label, taxon, sum(n_reads) OVER (PARTITION BY label ORDER BY n_reads DESC,taxon ROWS UNBOUNDED PRECEDING) AS cum FROM totals")
def cumulative(d: Domain):
    w = W("label").orderBy(F.desc("n_reads"), "taxon").rowsBetween(Window.unboundedPreceding, 0)
    return d.totals.select("label", "taxon", F.sum("n_reads").over(w).alias("cum"))


@query(
    "w12_state_switches",
    "SELECT user_id, count(*) FILTER (WHERE event_type<>prev) AS switches, round(1-count(*) FILTER (WHERE event_type<>prev)*1.0/nullif(count(*)-1,0),6) AS self_rate FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts,event_id) prev FROM events) GROUP BY 1",
)
def switches(d: Domain):
    e = d.table("events").select("user_id", "event_type", F.lag("event_type").over(W("user_id").orderBy("ts", "event_id")).alias("prev"))
    g = e.groupBy("user_id").agg(F.count_if(F.col("event_type") != F.col("prev")).alias("switches"), n_rows().alias("n"))
    return g.select("user_id", "switches", F.round(1 - F.try_divide(F.col("switches").cast("double"), F.col("n") - 1), 6).alias("self_rate"))


@query("w13_rank_label", "SELECT label, core||'_'||lpad((row_number() OVER (PARTITION BY core ORDER BY age_kyr DESC,label))::VARCHAR,5,'0') AS name FROM meta")
def rank_label(d: Domain):
    rn = F.row_number().over(W("core").orderBy(F.desc("age_kyr"), "label"))
    return d.meta.select("label", F.concat_ws("_", "core", F.lpad(rn.cast("string"), 5, "0")).alias("name"))


@query("w14_first_last", "SELECT core, min_by(label,(y_bp,label)) AS youngest, max_by(label,(y_bp,label)) AS oldest FROM meta GROUP BY 1")
def first_last(d: Domain):
    k = F.struct("y_bp", "label")
    return d.meta.groupBy("core").agg(F.min_by("label", k).alias("youngest"), F.max_by("label", k).alias("oldest"))


@query("c04_centred_check", "SELECT DISTINCT threshold, true AS centred FROM prevalent")
def centred_check(d: Domain):
    return abundance.check_centred(d.clr).select("threshold", (F.col("worst") <= 1e-10).alias("centred"))


@query(
    "c09_weighted_context",
    "SELECT taxon, round(sum(w*mis)/sum(w),6) AS mu, sum(w*mis)/sum(w)>=4.0 AS glacial_like FROM (SELECT t.taxon, t.abundance w, m.mis FROM totals t JOIN meta m USING(label) WHERE abundance>0) GROUP BY 1",
)
def weighted_context(d: Domain):
    t = d.totals.join(d.meta.select("label", "mis"), "label").where("abundance > 0")
    g = t.groupBy("taxon").agg((F.sum(F.col("abundance") * F.col("mis")) / F.sum("abundance")).alias("mu"))
    return g.select("taxon", F.round("mu", 6).alias("mu"), (F.col("mu") >= 4.0).alias("glacial_like"))


@query(
    "c11_ranking_change",
    "SELECT taxon, a.r::INT AS before, b.r::INT AS after, (b.r-a.r)::INT AS delta FROM (SELECT taxon, row_number() OVER (ORDER BY sum(n_reads) DESC, taxon) r FROM totals GROUP BY 1) a FULL JOIN (SELECT taxon, row_number() OVER (ORDER BY sum(abundance) DESC, taxon) r FROM totals WHERE abundance>0 GROUP BY 1) b USING (taxon)",
)
def ranking_change(d: Domain):
    def rank(df, x, n):
        placed = ordered.positions(df.groupBy("taxon").agg(F.sum(x).alias("s")), [F.desc("s"), F.col("taxon")])
        return placed.select("taxon", (F.col("position") + 1).cast("int").alias(n))

    out = rank(d.totals, "n_reads", "before").join(rank(d.totals.where("abundance > 0"), "abundance", "after"), "taxon", "full_outer")
    return out.withColumn("delta", F.col("after") - F.col("before"))


@query(
    "c12_timeline",
    "SELECT m.label, m.core, round(m.age_kyr,6) AS age_kyr, t.n AS taxa, t.reads FROM meta m LEFT JOIN (SELECT label, count(*) n, sum(n_reads) reads FROM totals GROUP BY 1) t USING(label)",
)
def timeline(d: Domain):
    t = d.totals.groupBy("label").agg(n_rows().alias("taxa"), F.sum("n_reads").alias("reads"))
    return d.meta.select("label", "core", F.round("age_kyr", 6).alias("age_kyr")).join(t, "label", "left")
