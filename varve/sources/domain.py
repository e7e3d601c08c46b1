"""Abundance records, samples and taxa as views over the star-schema tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.operators import abundance
from varve.operators.staging import Workspace

CORES = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
EXCLUDED = [13]
MAX_AGE_KYR = 150.0
THRESHOLDS = [3, 5, 10]
PRIMARY = 5


class Domain:
    """Lazy views of one data folder; nothing is read before a query uses it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def samples(self) -> DataFrame:
        """One row per sample: label, core, age and covariates."""
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = self.table("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        age = (F.col("s_suppkey") * 7919) % 160000
        return rows.select(
            F.col("s_suppkey").alias("label"),
            F.col("r_name").alias("core"),
            age.alias("y_bp"),
            (age / 1000.0).alias("age_kyr"),
            (3.1 + (F.col("s_suppkey") % 20) / 10.0).alias("mis"),
            (F.col("s_acctbal") / 1000.0).alias("sst"),
        )

    @cached_property
    def meta(self) -> DataFrame:
        return abundance.select_samples(self.samples, CORES, MAX_AGE_KYR, EXCLUDED)

    @cached_property
    def records(self) -> DataFrame:
        """Many rows per taxon and sample."""
        part = self.table("part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("taxon"), "p_type", "p_brand")
        rows = self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(
            "taxon",
            F.col("l_suppkey").alias("label"),
            F.when(F.col("l_linestatus") == "F", "d__Bacteria").otherwise("d__Archaea").alias("domain"),
            F.when(F.col("l_returnflag") == "R", "Damaged").otherwise("Intact").alias("is_dmg"),
            F.col("l_quantity").alias("n_reads"),
            F.when(F.col("l_discount") >= 0.09, F.col("l_quantity")).otherwise(0.0).alias("abundance"),
            F.col("l_extendedprice").alias("reference_length"),
        )

    @cached_property
    def taxa(self) -> DataFrame:
        """One row per taxon: functional group and phylum."""
        part = self.table("part")
        return part.select(
            F.concat_ws("/", "p_brand", "p_type").alias("taxon"), F.col("p_type").alias("functional_group"), F.col("p_brand").alias("phylum")
        ).distinct()

    @cached_property
    def totals(self) -> DataFrame:
        return abundance.aggregate_records(abundance.select_records(self.records, self.meta, ["d__Archaea", "d__Bacteria", "d__Viruses"]))

    @cached_property
    def prevalent(self) -> DataFrame:
        return abundance.prevalent_taxa(self.totals, THRESHOLDS)

    @cached_property
    def cells(self) -> DataFrame:
        return abundance.zero_filled(self.totals, self.prevalent, self.meta)

    @cached_property
    def clr(self) -> DataFrame:
        return abundance.centred_log_ratio(self.cells)

    @cached_property
    def clr_primary(self) -> DataFrame:
        """The log-ratio table of the primary threshold with its core and age."""
        return self.clr.where(F.col("threshold") == PRIMARY).join(self.meta.select("label", "core", "age_kyr", "mis", "sst"), "label")

    def stored(self, ws: Workspace) -> Domain:
        """The same views over a log-ratio table that is written once, for queries that read it several times."""
        kept = Domain(self.spark, self.sf_dir)
        kept.clr_primary = ws.table(self.clr_primary, "log-ratios")
        return kept

    @cached_property
    def edges(self) -> DataFrame:
        from varve.operators import graphs

        return graphs.association_graph(self.clr_primary, "pearson")
