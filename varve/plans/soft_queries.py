"""Soft modules of the taxa in every core, on two levels, and their consensus over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import graphs, soft_modules
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import Domain

#: Coupling of the two most similar cores, and rounds of updates.
COUPLING, ROUNDS = 0.25, 20


def assigned_taxa(d: Domain, ws: Workspace) -> tuple[DataFrame, DataFrame, int, int]:
    """Memberships of the taxa seen in every core, of the first level's modules in the second's, and both numbers of modules.

    Cores are coupled in proportion to the Jaccard index of their edges.
    """
    d = d.stored(ws)
    edges = ws.table(d.edges, "edges")
    seen = ws.table(d.clr_primary.where("abundance > 0").select(F.col("core").alias("graph"), F.col("taxon").alias("node")).distinct(), "seen")
    first, second = soft_modules.dimensions(seen.select("node").distinct().count())
    alike = graphs.edge_jaccard(edges).select("core_a", "core_b", F.coalesce("edge_jaccard", F.lit(0.0))).collect()  # one row per pair of cores
    most = max((j for _, _, j in alike), default=0.0)
    couplings = [(a, b, COUPLING * j / most) for a, b, j in alike if j > 0]
    links = edges.select(F.col("core").alias("graph"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    state, _ = soft_modules.fit(seen, links, first, couplings, ROUNDS, ws)
    taxa = ws.table(soft_modules.memberships(state), "taxa")
    modules = seen.select("graph").distinct().withColumn("node", F.explode(F.array(*[F.lit(f"M{i + 1}") for i in range(first)])))
    upper, _ = soft_modules.fit(modules, soft_modules.pooled(taxa, links, first), second, couplings, ROUNDS, ws)
    return taxa, ws.table(soft_modules.memberships(upper), "modules"), first, second


@query("m06_soft_modules")
def soft(d: Domain):
    """Probabilities of every taxon's modules in every core where it is seen, the likeliest one, and that one's own module."""
    ws = Workspace(d.spark, "soft")
    taxa, modules, _, _ = assigned_taxa(d, ws)
    likeliest = F.array_position("probability", F.array_max("probability")).cast("int")
    upper = modules.select("graph", F.col("node").alias("module"), F.concat(F.lit("S"), likeliest).alias("super_module"))
    rows = taxa.withColumn("module", F.concat(F.lit("M"), likeliest)).join(upper, ["graph", "module"])
    return rows.select(F.col("node").alias("taxon"), F.col("graph").alias("core"), "module", "super_module", F.transform("probability", lambda p: F.round(p, 6)).alias("probability"))


@query("m07_module_consensus")
def consensus(d: Domain):
    """The module of every taxon by its mean probabilities over the cores, with the mean entropy of its assignments."""
    ws = Workspace(d.spark, "soft")
    taxa, _, first, _ = assigned_taxa(d, ws)
    found = soft_modules.consensus(taxa, first)
    return found.select(F.col("node").alias("taxon"), F.concat(F.lit("M"), "module").alias("consensus_module"), F.round("mean_entropy", 6).alias("mean_assignment_entropy"), F.col("n_graphs").alias("cores_present"))
