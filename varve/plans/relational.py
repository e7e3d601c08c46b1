"""Filters, projections, joins, set operations, reshaping, sorting and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from varve.functions import columns as C
from varve.plans.base import query
from varve.sources import tables
from varve.sources.domain import CORES, Domain

W = Window.partitionBy


@query("s01_column_scan", "SELECT taxon, label, n_reads FROM records WHERE n_reads>40")
def column_scan(d: Domain):
    return d.records.where("n_reads > 40").select("taxon", "label", "n_reads")


@query("s21_table_profile", "SELECT 'supplier' AS name, count(*) AS n_rows, 4 AS n_columns, 's_suppkey,s_name,s_nationkey,s_acctbal' AS columns FROM supplier")
def table_profile(d: Domain):
    df = tables.require_columns(d.table("supplier"), ["s_suppkey"])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("supplier").alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(",".join(df.columns)).alias("columns")
    )


@query("p01_sample_filter", "SELECT label, core, y_bp, round(age_kyr,6) AS age_kyr FROM meta")
def sample_filter(d: Domain):
    return d.meta.select("label", "core", "y_bp", F.round("age_kyr", 6).alias("age_kyr"))


@query("p02_record_filter", "SELECT domain, count(*) AS n, sum(n_reads) AS reads FROM records WHERE is_dmg='Damaged' AND label IN (SELECT label FROM meta) GROUP BY ALL")
def record_filter(d: Domain):
    kept = d.records.where(F.col("is_dmg") == "Damaged").join(d.meta.select("label"), "label", "left_semi")
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("n_reads").alias("reads"))


@query("p03_derived_columns", "SELECT label, round(y_bp/1000.0,6) AS age_kyr, round(log10(y_bp+1),6) AS log_age FROM samples")
def derived(d: Domain):
    return d.samples.select("label", F.round(F.col("y_bp") / 1000.0, 6).alias("age_kyr"), F.round(F.log10(F.col("y_bp") + 1), 6).alias("log_age"))


@query("p04_null_fill", "SELECT m.label, coalesce(sum(t.n_reads),0) AS reads, coalesce(sum(t.n_records),0)::BIGINT AS n FROM meta m LEFT JOIN totals t USING (label) GROUP BY m.label")
def null_fill(d: Domain):
    sums = d.totals.groupBy("label").agg(F.sum("n_reads").alias("reads"), F.sum("n_records").alias("n"))
    return d.meta.select("label").join(sums, "label", "left").fillna(0, ["reads", "n"])


@query("p05_finite", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax=0 THEN 0 ELSE round(l_discount/l_tax,6) END AS ratio FROM lineitem")
def finite(d: Domain):
    x = d.table("lineitem").select("l_orderkey", "l_linenumber", F.try_divide("l_discount", "l_tax").alias("ratio"))
    return tables.finite(x, ["ratio"], 0.0).withColumn("ratio", F.round("ratio", 6))


@query("p06_numeric_columns", "SELECT s_acctbal, s_suppkey FROM supplier")
def numeric(d: Domain):
    s = d.table("supplier")
    return s.select(*tables.numeric_columns(s, ("s_nationkey",)))


@query("p07_select_present", "SELECT label, core FROM meta")
def present(d: Domain):
    return tables.select_present(d.meta, ["label", "missing", "core"])


@query("p08_edge_sign", "SELECT core, src, dst, CASE WHEN signed_weight>=0 THEN 'positive' ELSE 'negative' END AS sign FROM edges")
def edge_sign(d: Domain):
    return d.edges.select("core", "src", "dst", F.when(F.col("signed_weight") >= 0, "positive").otherwise("negative").alias("sign"))


@query("p09_case_classes", "SELECT label, CASE WHEN sst IS NULL THEN 'unknown' WHEN sst<2 THEN 'cold' WHEN sst<6 THEN 'mild' ELSE 'warm' END AS class FROM samples")
def classes(d: Domain):
    c = F.when(F.col("sst").isNull(), "unknown").when(F.col("sst") < 2, "cold").when(F.col("sst") < 6, "mild").otherwise("warm")
    return d.samples.select("label", c.alias("class"))


@query("p10_dynamic_filters", "SELECT label, core FROM samples WHERE core='ASIA' AND age_kyr<=80")
def dynamic(d: Domain, core: str | None = "ASIA", max_age: float | None = 80, label: int | None = None):
    tests = [F.col("core") == core] if core else []
    tests += [F.col("age_kyr") <= max_age] if max_age is not None else []
    tests += [F.col("label") == label] if label is not None else []
    return reduce(lambda df, t: df.where(t), tests, d.samples).select("label", "core")


@query("p11_substring_search", "SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ',p_name,p_brand,p_type)),'ring')")
def substring(d: Domain):
    return d.table("part").where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("ring")).select("p_partkey")


@query("p12_focus_edges", "SELECT core, src, dst FROM edges WHERE src='Brand#1/ECONOMY' OR dst='Brand#1/ECONOMY'")
def focus_edges(d: Domain):
    f = "Brand#1/ECONOMY"
    return d.edges.where((F.col("src") == f) | (F.col("dst") == f)).select("core", "src", "dst")


@query("p13_upper_triangle", "SELECT core, src, dst, round(abs(r),6) AS w FROM corrs WHERE abs(r)>=0.3")
def upper_triangle(d: Domain):
    from varve.operators.graphs import correlations

    return correlations(d.clr_primary).where(F.abs("r") >= 0.3).select("core", "src", "dst", F.round(F.abs("r"), 6).alias("w"))


@query(
    "p14_cascading_window",
    """SELECT label, core, round(age_kyr,6) AS age_kyr FROM (SELECT *, min(tier) OVER () AS best FROM (SELECT *, CASE WHEN core='ASIA' AND abs(age_kyr-60)<=10 THEN 1
    WHEN core='ASIA' THEN 2 WHEN row_number() OVER (ORDER BY age_kyr,label)<=5 THEN 3 END AS tier FROM meta)) WHERE tier=best""",
)
def cascading(d: Domain):
    return select_by_age(d.meta, "ASIA", 60.0).select("label", "core", F.round("age_kyr", 6).alias("age_kyr"))


def select_by_age(meta, core: str, age: float, width: float = 10.0):
    """Samples of a core near an age; else of the core; else the five youngest."""
    youngest = meta.orderBy("age_kyr", "label").limit(5).select("label", F.lit(True).alias("young"))
    tiers = meta.join(F.broadcast(youngest), "label", "left")
    tier = F.when((F.col("core") == core) & (F.abs(F.col("age_kyr") - age) <= width), 1).when(F.col("core") == core, 2).when(F.col("young"), 3)
    tiers = tiers.withColumn("tier", tier).drop("young").where("tier is not null")
    best = tiers.agg(F.min("tier").alias("best"))
    return tiers.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("tier", "best")


@query("p15_quantile_predicate", "SELECT label FROM samples WHERE sst>=(SELECT quantile_cont(sst,0.75) FROM samples)")
def quantile_predicate(d: Domain):
    q = d.samples.agg(F.percentile("sst", F.lit(0.75)).alias("q"))
    return d.samples.crossJoin(F.broadcast(q)).where("sst >= q").select("label")


@query("p16_null_safe_flag", "SELECT s.label, coalesce(t.n>5,false) AS flagged FROM samples s LEFT JOIN (SELECT label,count(*) n FROM totals GROUP BY 1) t USING (label)")
def null_safe(d: Domain):
    n = d.totals.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return d.samples.join(n, "label", "left").select("label", F.coalesce(F.col("n") > 5, F.lit(False)).alias("flagged"))


@query("p17_columns_by_pattern", "SELECT l_quantity, l_extendedprice FROM lineitem")
def by_pattern(d: Domain):
    li = d.table("lineitem")
    return li.select(li.colRegex("`l_(quantity|extendedprice)`"))


@query("j01_semi_join", "SELECT label FROM samples WHERE label IN (SELECT label FROM totals)")
def semi(d: Domain):
    return d.samples.join(d.totals, "label", "left_semi").select("label")


@query("j02_anti_join", "SELECT label FROM samples WHERE label NOT IN (SELECT label FROM totals)")
def anti(d: Domain):
    return d.samples.join(d.totals, "label", "left_anti").select("label")


@query("j03_left_join", "SELECT t.taxon, t.label, m.functional_group FROM totals t LEFT JOIN taxa m USING (taxon)")
def left(d: Domain):
    return d.totals.join(d.taxa, "taxon", "left").select("taxon", "label", "functional_group")


@query("j04_inner_join", "SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON c_custkey=o_custkey GROUP BY 1")
def inner(d: Domain):
    j = d.table("customer").join(d.table("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "j05_full_outer",
    """SELECT coalesce(a.taxon,b.taxon) AS taxon, a.n AS n_asia, b.n AS n_europe FROM (SELECT taxon,count(*) n FROM totals JOIN meta USING(label) WHERE core='ASIA' GROUP BY 1) a
    FULL JOIN (SELECT taxon,count(*) n FROM totals JOIN meta USING(label) WHERE core='EUROPE' GROUP BY 1) b ON a.taxon=b.taxon""",
)
def full_outer(d: Domain):
    t = d.totals.join(d.meta.select("label", "core"), "label")
    of = lambda core, name: t.where(F.col("core") == core).groupBy("taxon").agg(F.count(F.lit(1)).alias(name))
    return of("ASIA", "n_asia").join(of("EUROPE", "n_europe"), "taxon", "full_outer")


@query("j06_suffix_join", "SELECT a.core, a.n AS n_all, b.n AS n_kept FROM (SELECT core,count(*) n FROM samples GROUP BY 1) a LEFT JOIN (SELECT core,count(*) n FROM meta GROUP BY 1) b USING (core)")
def suffixes(d: Domain):
    a, b = d.samples.groupBy("core").count(), d.meta.groupBy("core").count()
    return a.withColumnRenamed("count", "n_all").join(b.withColumnRenamed("count", "n_kept"), "core", "left")


@query(
    "j07_reduce_join",
    "SELECT s.core, a.lo, b.hi, c.n FROM (SELECT DISTINCT core FROM samples) s LEFT JOIN (SELECT core,min(mis) lo FROM samples GROUP BY 1) a USING(core) LEFT JOIN (SELECT core,max(mis) hi FROM samples GROUP BY 1) b USING(core) LEFT JOIN (SELECT core,count(*) n FROM meta GROUP BY 1) c USING(core)",
)
def reduce_join(d: Domain):
    parts = [d.samples.groupBy("core").agg(F.min("mis").alias("lo")), d.samples.groupBy("core").agg(F.max("mis").alias("hi")), d.meta.groupBy("core").agg(F.count(F.lit(1)).alias("n"))]
    return reduce(lambda a, b: a.join(b, "core", "left"), parts, d.samples.select("core").distinct())


@query("j08_theta_pairs", "SELECT a.core AS core_a, b.core AS core_b FROM (SELECT DISTINCT core FROM meta) a JOIN (SELECT DISTINCT core FROM meta) b ON a.core<b.core")
def theta(d: Domain):
    c = d.meta.select("core").distinct()
    return c.select(F.col("core").alias("core_a")).join(c.select(F.col("core").alias("core_b")), F.col("core_a") < F.col("core_b"))


@query("j09_zero_filled_grid", "SELECT threshold, taxon, label, abundance FROM cells")
def grid(d: Domain):
    return d.cells.select("threshold", "taxon", "label", "abundance")


@query("j10_pairwise_products", "SELECT core, src, dst, n, round(r,6) AS r FROM corrs")
def pairwise(d: Domain):
    from varve.operators.graphs import correlations

    return correlations(d.clr_primary).select("core", "src", "dst", "n", F.round("r", 6).alias("r"))


@query("j11_update_join", "SELECT s.label, coalesce(u.sst2, s.sst) AS sst FROM samples s LEFT JOIN (SELECT label, sst+1 AS sst2 FROM meta WHERE core='ASIA') u USING (label)")
def update_join(d: Domain):
    u = d.meta.where("core = 'ASIA'").select("label", (F.col("sst") + 1).alias("new"))
    return d.samples.join(u, "label", "left").select("label", F.coalesce("new", "sst").alias("sst"))


@query("j12_lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey=n_nationkey")
def lookup(d: Domain):
    return d.table("customer").join(d.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query(
    "j13_coalescing_key",
    """SELECT DISTINCT k.id, n.hit FROM (SELECT 'GCA_'||p_partkey AS id FROM part) k LEFT JOIN (SELECT CASE WHEN p_partkey%3=0 THEN 'GCA_' ELSE 'GCF_' END||p_partkey AS key, p_name AS hit FROM part WHERE p_size>25) n
    ON n.key=k.id OR n.key=regexp_replace(k.id,'^GCA_','GCF_')""",
)
def coalescing_key(d: Domain):
    part = d.table("part")
    ids = part.select(F.concat(F.lit("GCA_"), F.col("p_partkey").cast("string")).alias("id"))
    source = part.where("p_size > 25").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "GCA_").otherwise("GCF_"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("hit"))
    keys = ids.select("id", F.explode(F.array("id", F.regexp_replace("id", "^GCA_", "GCF_"))).alias("key"))
    found = keys.join(source, "key").select("id", "hit").distinct()
    return ids.join(found, "id", "left")


@query("j14_fallback_source", "SELECT taxon, 'primary' AS source FROM prevalent WHERE threshold=5 UNION ALL SELECT taxon,'secondary' FROM taxa WHERE taxon NOT IN (SELECT taxon FROM prevalent WHERE threshold=5)")
def fallback(d: Domain):
    first = d.prevalent.where("threshold = 5").select("taxon", F.lit("primary").alias("source"))
    rest = d.taxa.join(first, "taxon", "left_anti").select("taxon", F.lit("secondary").alias("source"))
    return first.unionByName(rest)


@query("j15_default_fill", "SELECT t.taxon, coalesce(p.n_samples::VARCHAR,'grey') AS module FROM taxa t LEFT JOIN (SELECT * FROM prevalent WHERE threshold=10) p USING (taxon)")
def default_fill(d: Domain):
    p = d.prevalent.where("threshold = 10").select("taxon", F.col("n_samples").cast("string").alias("m"))
    return d.taxa.join(p, "taxon", "left").select("taxon", F.coalesce("m", F.lit("grey")).alias("module"))


@query("j17_both_ends", "SELECT core, src, dst FROM edges WHERE src IN (SELECT taxon FROM prevalent WHERE threshold=10) AND dst IN (SELECT taxon FROM prevalent WHERE threshold=10)")
def both_ends(d: Domain):
    keep = d.prevalent.where("threshold = 10").select("taxon")
    e = d.edges.join(keep, F.col("src") == F.col("taxon"), "left_semi").join(keep, F.col("dst") == F.col("taxon"), "left_semi")
    return e.select("core", "src", "dst")


@query(
    "j18_priority_union",
    "SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pri, source) rn FROM (SELECT taxon AS id,'prevalent' AS source,0 AS pri FROM prevalent WHERE threshold=10 UNION ALL SELECT taxon,'known',1 FROM taxa)) WHERE rn=1",
)
def priority_union(d: Domain):
    u = d.prevalent.where("threshold = 10").select(F.col("taxon").alias("id"), F.lit("prevalent").alias("source"), F.lit(0).alias("pri"))
    u = u.unionByName(d.taxa.select(F.col("taxon").alias("id"), F.lit("known").alias("source"), F.lit(1).alias("pri")))
    return u.groupBy("id").agg(F.min_by("source", F.struct("pri", "source")).alias("source"))


@query(
    "j19_key_grid",
    "SELECT g.functional_group, c.core, coalesce(n.n,0)::BIGINT AS n FROM (SELECT DISTINCT functional_group FROM taxa) g CROSS JOIN (SELECT DISTINCT core FROM meta) c LEFT JOIN (SELECT functional_group, core, count(*) n FROM totals JOIN taxa USING(taxon) JOIN meta USING(label) GROUP BY ALL) n ON n.functional_group=g.functional_group AND n.core=c.core",
)
def key_grid(d: Domain):
    n = d.totals.join(d.taxa, "taxon").join(d.meta.select("label", "core"), "label").groupBy("functional_group", "core").agg(F.count(F.lit(1)).alias("n"))
    keys = d.taxa.select("functional_group").distinct().crossJoin(F.broadcast(d.meta.select("core").distinct()))
    return keys.join(n, ["functional_group", "core"], "left").fillna(0, ["n"])


@query("u01_union_fill", "SELECT taxon AS id, functional_group, NULL::VARCHAR AS core FROM taxa UNION ALL SELECT label::VARCHAR, NULL, core FROM meta")
def union_fill(d: Domain):
    a, b = d.taxa.select(F.col("taxon").alias("id"), "functional_group"), d.meta.select(F.col("label").cast("string").alias("id"), "core")
    return a.unionByName(b, allowMissingColumns=True)


@query("u03_intersect", "SELECT label FROM meta INTERSECT SELECT label FROM totals")
def intersect(d: Domain):
    return d.meta.select("label").intersect(d.totals.select("label"))


@query("u04_distinct_first", "SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) rn FROM part) WHERE rn=1")
def distinct_first(d: Domain):
    return d.table("part").groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("p_name"))


@query("u05_ordered_unique", "SELECT 1 AS k, 'b,a,c' AS items")
def ordered_unique(d: Domain):
    u = F.array_distinct(F.concat(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("c"), F.lit("a"))))
    return d.spark.range(1).select(F.lit(1).alias("k"), F.array_join(u, ",").alias("items"))


@query("u06_difference", "SELECT taxon FROM taxa EXCEPT SELECT taxon FROM prevalent WHERE threshold=10")
def difference(d: Domain):
    return d.taxa.select("taxon").exceptAll(d.prevalent.where("threshold = 10").select("taxon"))


@query(
    "u07_best_match",
    """SELECT a, b, round(j,6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY j DESC, b) rn FROM (SELECT x.a, x.b, n*1.0/(na+nb-n) AS j FROM
    (SELECT p_type a, p_size%7 b, count(*) n FROM part GROUP BY ALL) x JOIN (SELECT p_type a,count(*) na FROM part GROUP BY 1) y USING(a) JOIN (SELECT p_size%7 b,count(*) nb FROM part GROUP BY 1) z USING(b))) WHERE rn=1""",
)
def best_match(d: Domain):
    x = d.table("part").select(F.col("p_type").alias("a"), (F.col("p_size") % 7).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    na, nb = F.sum("n").over(W("a")), F.sum("n").over(W("b"))
    x = x.withColumn("j", F.col("n") / (na + nb - F.col("n")))
    best = x.groupBy("a").agg(F.max_by(F.struct("b", "j"), F.struct("j", -F.col("b"))).alias("m"))
    return best.select("a", "m.b", F.round("m.j", 6).alias("jaccard"))


@query("r01_pivot", "SELECT taxon, " + ", ".join(f"coalesce(sum(abundance) FILTER (WHERE core='{c}'),0) AS \"{c}\"" for c in CORES) + " FROM totals JOIN meta USING(label) GROUP BY taxon")
def pivot(d: Domain):
    t = d.totals.join(d.meta.select("label", "core"), "label")
    return t.groupBy("taxon").pivot("core", CORES).agg(F.sum("abundance")).fillna(0.0)


@query("r02_unpivot", "SELECT label, 'mis' AS variable, mis AS value FROM samples UNION ALL SELECT label,'sst',sst FROM samples")
def unpivot(d: Domain):
    return d.samples.unpivot("label", ["mis", "sst"], "variable", "value")


@query(
    "r04_mirrored_pairs",
    "SELECT a, b, n FROM (SELECT least(a,b) a, greatest(a,b) b, n FROM (SELECT 'x' a,'y' b,1 n)) UNION ALL SELECT 'y','x',1 UNION ALL SELECT 'x','x',0 UNION ALL SELECT 'y','y',0",
)
def mirrored(d: Domain):
    e = d.spark.range(1).select(F.lit("x").alias("a"), F.lit("y").alias("b"), F.lit(1).alias("n"))
    back = e.select(F.col("b").alias("a"), F.col("a").alias("b"), "n")
    ends = e.select(F.explode(F.array("a", "b")).alias("a")).distinct().select("a", F.col("a").alias("b"), F.lit(0).alias("n"))
    return e.unionByName(back).unionByName(ends)


@query("r05_explode_maps", "SELECT p_partkey, 'M'||(p_size%9) AS module, round((p_size%10)/10.0,6) AS completeness FROM part UNION ALL SELECT p_partkey,'W'||(p_size%4),0.5 FROM part")
def explode_maps(d: Domain):
    text = F.concat(F.lit("M"), (F.col("p_size") % 9).cast("string"), F.lit(":"), ((F.col("p_size") % 10) / 10.0).cast("string"), F.lit(";W"), (F.col("p_size") % 4).cast("string"), F.lit(":0.5"))
    p = d.table("part").select("p_partkey", F.explode(F.str_to_map(text, F.lit(";"), F.lit(":"))).alias("module", "v"))
    return p.select("p_partkey", "module", F.round(F.col("v").cast("double"), 6).alias("completeness"))


@query("o01_sort_o02_limit", "SELECT label, sst FROM samples ORDER BY sst DESC NULLS LAST, label LIMIT 20")
def sort_limit(d: Domain):
    return d.samples.orderBy(F.desc_nulls_last("sst"), "label").limit(20).select("label", "sst")


@query(
    "o03_top_variable",
    "SELECT core, taxon, rn FROM (SELECT core, taxon, row_number() OVER (PARTITION BY core ORDER BY round(v,9) DESC, taxon)::INT rn FROM (SELECT core,taxon,var_samp(clr) v FROM clr5 GROUP BY ALL)) WHERE rn<=10",
)
def top_variable(d: Domain):
    v = d.clr_primary.groupBy("core", "taxon").agg(F.round(F.var_samp("clr"), 9).alias("v"))
    return v.withColumn("rn", F.row_number().over(W("core").orderBy(F.desc("v"), "taxon"))).where("rn <= 10").select("core", "taxon", "rn")


@query("o04_external_order", "SELECT label, core, list_position(['EUROPE','ASIA','AMERICA','AFRICA'],core)::BIGINT AS place FROM meta")
def external_order(d: Domain):
    order = F.array(*[F.lit(c) for c in reversed(CORES)])
    return d.meta.select("label", "core", F.array_position(order, F.col("core")).alias("place")).orderBy("place", "label")


@query("o05_smallest", "SELECT label FROM meta ORDER BY age_kyr, label LIMIT 5")
def smallest(d: Domain):
    return d.meta.orderBy("age_kyr", "label").limit(5).select("label")


@query("o06_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey::VARCHAR||':42'), o_orderkey LIMIT 100")
def seeded_sample(d: Domain):
    h = F.md5(F.concat_ws(":", F.col("o_orderkey").cast("string"), F.lit("42")))
    return d.table("orders").orderBy(h, "o_orderkey").limit(100).select("o_orderkey")


@query(
    "o07_bootstrap",
    """SELECT b.b::INT AS replicate, i.core, i.label FROM (SELECT core, label, row_number() OVER (PARTITION BY core ORDER BY label)-1 AS k, count(*) OVER (PARTITION BY core) AS n FROM meta) s
    CROSS JOIN (SELECT unnest(range(1,4)) b) b JOIN (SELECT core, label, row_number() OVER (PARTITION BY core ORDER BY label)-1 AS k FROM meta) i
    ON i.core=s.core AND i.k=(('0x'||substr(md5(b.b::VARCHAR||':'||s.core||':'||s.k::VARCHAR),1,8))::BIGINT % s.n)""",
)
def bootstrap(d: Domain):
    s = d.meta.select("core", "label", (F.row_number().over(W("core").orderBy("label")) - 1).alias("k"), F.count(F.lit(1)).over(W("core")).alias("n"))
    draws = s.select("core", "k", "n", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("replicate"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("replicate").cast("string"), "core", F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    draws = draws.select("replicate", "core", (h % F.col("n")).cast("int").alias("k"))
    return draws.join(s.select("core", "k", "label"), ["core", "k"]).select("replicate", "core", "label")


@query(
    "o08_stratified_split",
    "SELECT doc_id, rn<=ceil(0.8*n) AS train FROM (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR),doc_id) rn, count(*) OVER (PARTITION BY quality) n FROM labels)",
)
def stratified(d: Domain):
    w = W("quality")
    rn = F.row_number().over(w.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return d.table("labels").select("doc_id", (rn <= F.ceil(0.8 * F.count(F.lit(1)).over(w))).alias("train"))


@query(
    "o09_balanced_quota",
    """SELECT label, core, b::BIGINT AS age_bin FROM (SELECT *, row_number() OVER (PARTITION BY core,b ORDER BY md5(label::VARCHAR),label) rn FROM (SELECT *, min(n) OVER (PARTITION BY b) quota, count(*) OVER (PARTITION BY b) k FROM
    (SELECT label, core, floor(age_kyr/50)*50 AS b, count(*) OVER (PARTITION BY core, floor(age_kyr/50)*50) n FROM meta))) WHERE rn<=quota""",
)
def balanced(d: Domain):
    b = d.meta.select("label", "core", (F.floor(F.col("age_kyr") / 50) * 50).alias("age_bin"))
    n = b.groupBy("core", "age_bin").agg(F.count(F.lit(1)).alias("n")).groupBy("age_bin").agg(F.min("n").alias("quota"))
    rn = F.row_number().over(W("core", "age_bin").orderBy(F.md5(F.col("label").cast("string")), "label"))
    return b.join(n, "age_bin").withColumn("rn", rn).where("rn <= quota").select("label", "core", "age_bin")


@query("o10_fixed_bins", "SELECT core, (floor(age_kyr/10)*10)::BIGINT AS bin, (floor(age_kyr/10)*10)::BIGINT||'-'||(floor(age_kyr/10)*10+10)::BIGINT AS bin_label, count(*) AS n FROM meta GROUP BY ALL")
def fixed_bins(d: Domain):
    b = d.meta.select("core", (F.floor(F.col("age_kyr") / 10) * 10).alias("bin"))
    return b.withColumn("bin_label", F.concat_ws("-", F.col("bin").cast("string"), (F.col("bin") + 10).cast("string"))).groupBy("core", "bin", "bin_label").agg(F.count(F.lit(1)).alias("n"))


@query("o11_cut_breaks", "SELECT label, CASE WHEN age_kyr<11.7 THEN 0 WHEN age_kyr<71 THEN 1 WHEN age_kyr<130 THEN 2 ELSE 3 END AS band FROM meta")
def cut_breaks(d: Domain):
    breaks = [11.7, 71.0, 130.0]
    return d.meta.select("label", sum((F.col("age_kyr") >= b).cast("int") for b in breaks).alias("band"))


@query("o12_parameter_grid", "SELECT p, m, k FROM (SELECT unnest([3,5,10]) p), (SELECT unnest(['pearson','bicor']) m), (SELECT unnest([0.5,0.6]) k)")
def parameter_grid(d: Domain):
    g = d.spark.range(1).select(F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("p"))
    return g.select("p", F.explode(F.array(F.lit("pearson"), F.lit("bicor"))).alias("m")).select("p", "m", F.explode(F.array(F.lit(0.5), F.lit(0.6))).alias("k"))


@query("o13_top_with_ties", "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size DESC) r FROM part) WHERE r<=30")
def top_with_ties(d: Domain):
    top = d.table("part").orderBy(F.desc("p_size")).limit(30).agg(F.min("p_size").alias("least"))
    return d.table("part").join(F.broadcast(top), F.col("p_size") >= F.col("least")).select("p_partkey", "p_size")


@query("f01_slugify", "SELECT p_partkey, regexp_replace(regexp_replace('__'||p_brand||' / '||p_type||'!!','[^A-Za-z0-9]+','_','g'),'^_|_$','','g') AS slug FROM part")
def slugs(d: Domain):
    return d.table("part").select("p_partkey", C.slugify(F.concat(F.lit("__"), "p_brand", F.lit(" / "), "p_type", F.lit("!!"))).alias("slug"))


@query("f02_pair_key", "SELECT core, least(src,dst)||'--'||greatest(src,dst) AS pair FROM edges")
def pair_keys(d: Domain):
    return d.edges.select("core", C.pair_key(F.col("dst"), F.col("src")).alias("pair"))


@query("f03_age_in_text", "SELECT label, CAST(nullif(regexp_extract(lower('Core X at '||label||'.5 KYA'),'(\\d+(?:\\.\\d+)?)\\s*kya',1),'') AS DOUBLE) AS age FROM samples")
def ages(d: Domain):
    return d.samples.select("label", C.age_in_text(F.concat(F.lit("Core X at "), F.col("label").cast("string"), F.lit(".5 KYA"))).alias("age"))


@query(
    "f05_intent",
    "SELECT conv_id, turn, CASE WHEN regexp_matches(q,'seed|top 100 taxa|similar to core|what taxa would i need') THEN 'seeding' WHEN regexp_matches(q,'functional capabilities|what are the top functional|how might they work') THEN 'functional' WHEN regexp_matches(q,'glacial|interglacial|transition') THEN 'transition' ELSE 'general' END AS intent FROM (SELECT *, lower(text) q FROM conversations)",
)
def intents(d: Domain):
    return d.table("conversations").select("conv_id", "turn", C.intent(F.col("text")).alias("intent"))


@query("f06_threshold_label", "SELECT DISTINCT 'prev_'||threshold AS branch FROM prevalent")
def threshold_labels(d: Domain):
    return d.prevalent.select(C.prevalence_label(F.col("threshold")).alias("branch")).distinct()


@query("f07_join_text", "SELECT p_partkey, concat_ws(' ',nullif(trim(p_name),''),nullif(trim(p_brand),'')) AS text FROM part")
def join_text(d: Domain):
    part = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.table("part").select("p_partkey", F.concat_ws(" ", part("p_name"), part("p_brand")).alias("text"))


@query("f08_truncate", "SELECT doc_id, CASE WHEN length(text)>40 THEN substr(text,1,39)||'…' ELSE coalesce(text,'') END AS short FROM documents")
def truncated(d: Domain):
    return d.table("documents").select("doc_id", C.truncate(F.col("text"), 40).alias("short"))


@query("f09_format", "SELECT s_suppkey, coalesce(printf('%.2f',s_acctbal),'NA') AS bal FROM supplier")
def formatted(d: Domain):
    return d.table("supplier").select("s_suppkey", C.fixed(F.col("s_acctbal"), 2).alias("bal"))


@query("f11_json", "SELECT p_partkey, '[\"'||p_brand||'\",\"'||p_type||'\"]' AS tables FROM part")
def json_text(d: Domain):
    return d.table("part").select("p_partkey", F.to_json(F.array("p_brand", "p_type")).alias("tables"))


@query("f12_json_parse", "SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def json_parse(d: Domain):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    clean = F.trim(F.regexp_replace(fenced, "```(json)?", ""))
    return d.table("events").select("event_id", F.from_json(F.trim(F.regexp_replace(clean, "\n", "")), "k bigint").getField("k").alias("k"))


@query("f13_json_path", "SELECT event_id, json_extract_string(props,'$.k') AS k FROM events")
def json_path(d: Domain):
    return d.table("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("f15_math", "SELECT l_orderkey, l_linenumber, round(ln(l_quantity),6) AS a, round(log2((l_tax+1e-6)/(l_discount+1e-6)),6) AS b, round(1/(1+l_tax),6) AS c FROM lineitem")
def math_functions(d: Domain):
    a, b = F.log("l_quantity"), F.log2((F.col("l_tax") + 1e-6) / (F.col("l_discount") + 1e-6))
    return d.table("lineitem").select("l_orderkey", "l_linenumber", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), F.round(1 / (1 + F.col("l_tax")), 6).alias("c"))


@query(
    "f16_adaptive_log_ratio",
    "SELECT l_orderkey, l_linenumber, round(ln((l_tax+CASE WHEN l_tax>0 THEN l_tax/2 ELSE 1e-6 END)/(l_discount+CASE WHEN l_discount>0 THEN l_discount/2 ELSE 1e-6 END)),6) AS index FROM lineitem",
)
def log_ratios(d: Domain):
    return d.table("lineitem").select("l_orderkey", "l_linenumber", F.round(C.log_ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("index"))


@query("f19_array_ops", "SELECT label, length(list_intersect([label%3,label%5],[1,2]))::INT AS shared FROM samples")
def array_ops(d: Domain):
    return d.samples.select("label", F.size(F.array_intersect(F.array(F.col("label") % 3, F.col("label") % 5), F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).alias("shared"))


@query("f21_prefix_rewrite", "SELECT p_partkey, regexp_replace('GCA_'||p_partkey||'.V1','^GCA_','GCF_') AS a FROM part")
def prefix_rewrite(d: Domain):
    return d.table("part").select("p_partkey", F.regexp_replace(F.concat(F.lit("GCA_"), F.col("p_partkey").cast("string"), F.lit(".V1")), "^GCA_", "GCF_").alias("a"))
