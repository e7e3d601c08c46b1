"""Files and runs: import with provenance, graphs as GraphML, steps resumed in the middle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import graphs, steps
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import CORES, PRIMARY, Domain
from varve.sources.graph_files import read_graphml, write_graphml
from varve.sources.imports import import_files

#: Tables that the domain rests on, with the columns they must have.
IMPORTED = {"lineitem": ["l_partkey", "l_suppkey", "l_quantity"], "part": ["p_partkey", "p_brand", "p_type"], "supplier": ["s_suppkey", "s_nationkey"], "nation": ["n_nationkey"], "region": ["r_regionkey", "r_name"]}


@query(
    "s03_import_provenance",
    " UNION ALL ".join(f"SELECT '{t}.parquet' AS file, '{', '.join(c)}' AS required_columns, true AS present, true AS copied, false AS copied_again, (SELECT count(*) FROM {t}) AS n_rows" for t, c in IMPORTED.items()),
)
def import_provenance(d: Domain):
    """The tables copied into a folder of their own, once and again, with the rows that the copies hold."""
    ws = Workspace(d.spark, "import")
    folder = ws.path("files")
    files = [(f"{d.sf_dir}/{t}.parquet", c) for t, c in IMPORTED.items()]
    once = ws.table(import_files(d.spark, files, folder), "once")
    again = ws.table(import_files(d.spark, files, folder), "again").select("source", F.col("copied").alias("copied_again"))
    counts = reduce(DataFrame.unionByName, [d.spark.read.parquet(f"{folder}/{t}.parquet").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("file", F.lit(f"{t}.parquet")) for t in IMPORTED])
    named = once.join(again, "source").withColumn("file", F.substring_index("source", "/", -1))
    return named.join(counts, "file").select("file", "required_columns", "present", "copied", "copied_again", "n_rows")


@query("s09_graphml", f"SELECT core, src, dst, round(weight,6) AS weight FROM edges WHERE core IN ({','.join(repr(c) for c in CORES)})")
def graphml(d: Domain):
    """Every core's graph written as GraphML and read back."""
    ws = Workspace(d.spark, "graphml")
    edges = ws.table(d.edges, "edges")
    seen = ws.table(d.clr_primary.select("core", F.col("taxon").alias("node")).distinct(), "nodes")
    back = []
    for core in CORES:
        path = ws.path(core)
        write_graphml(seen.where(F.col("core") == core), edges.where(F.col("core") == core).select("src", "dst", "weight"), path)
        back.append(read_graphml(d.spark, path)[1].select(F.lit(core).alias("core"), "src", "dst", F.round("weight", 6).alias("weight")))
    return reduce(DataFrame.unionByName, back)


@query(
    "c01_resumed_steps",
    """SELECT '00' AS step, 'totals' AS name, 'reused' AS state, (SELECT count(*) FROM totals) AS n_rows UNION ALL SELECT '01', 'log-ratios', 'reused', (SELECT count(*) FROM clr5) UNION ALL SELECT '02', 'edges', 'computed', (SELECT count(*) FROM edges)""",
)
def resumed_steps(d: Domain):
    """Totals, log-ratios and edges as steps, run once whole and then from step 2, with the rows of each."""
    from varve.operators import abundance

    def ratios(done: dict[str, DataFrame]) -> DataFrame:
        prevalent = abundance.prevalent_taxa(done["00"], [PRIMARY])
        clr = abundance.centred_log_ratio(abundance.zero_filled(done["00"], prevalent, d.meta))
        return clr.join(d.meta.select("label", "core", "age_kyr", "mis", "sst"), "label")

    listed = [steps.Step("0", "totals", lambda done: d.totals), steps.Step("1", "log-ratios", ratios), steps.Step("2", "edges", lambda done: graphs.association_graph(done["01"], "pearson"))]
    folder = Workspace(d.spark, "steps").path("run")
    steps.run(d.spark, listed, folder)
    tables, states = steps.run(d.spark, listed, folder, start="2")
    rows = [tables[i].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), F.lit(state).alias("state"), "n_rows") for i, name, state in states]
    return reduce(DataFrame.unionByName, rows)
