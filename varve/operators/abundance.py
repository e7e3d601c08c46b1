"""From raw abundance records to sample-centred log-ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def select_samples(samples: DataFrame, cores: list[str], max_age: float, excluded: list) -> DataFrame:
    return samples.where(F.col("core").isin(cores) & (F.col("age_kyr") <= max_age) & ~F.col("label").isin(excluded))


def select_records(records: DataFrame, samples: DataFrame, domains: list[str]) -> DataFrame:
    """Damaged records of the wanted domains in known samples."""
    wanted = records.where((F.col("is_dmg") == "Damaged") & F.col("domain").isin(domains))
    return wanted.join(samples.select("label"), "label", "left_semi")


def aggregate_records(records: DataFrame) -> DataFrame:
    """One row per taxon and sample."""
    return records.groupBy("taxon", "label").agg(
        F.sum("n_reads").alias("n_reads"),
        F.sum("abundance").alias("abundance"),
        # Exact sums of cents, so that the mean does not depend on the order of the rows.
        (F.sum(F.col("reference_length").cast("decimal(18,2)")).cast("double") / F.count("reference_length")).alias("reference_length"),
        F.count(F.lit(1)).alias("n_records"),
    )


def prevalent_taxa(totals: DataFrame, thresholds: list[int]) -> DataFrame:
    """``(threshold, taxon, n_samples)`` for every threshold that the taxon's sample count reaches."""
    seen = totals.where("abundance > 0").groupBy("taxon").agg(F.count(F.lit(1)).alias("n_samples"))
    return seen.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where("n_samples >= threshold")


def zero_filled(totals: DataFrame, prevalent: DataFrame, samples: DataFrame, spread: int = 32) -> DataFrame:
    """Every sample of every prevalent taxon, absent cells as 0.

    The grid is the output itself (samples x taxa kept), so its size is that of the matrix asked for. It is an equi-join on
    ``spread`` groups of samples, which Spark broadcasts or shuffles by size, so neither side is computed anew per partition.
    """
    grouped = samples.select("label", F.pmod(F.xxhash64("label"), F.lit(spread)).cast("int").alias("group_"))
    taxa = prevalent.select("threshold", "taxon", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("group_"))
    grid = taxa.join(grouped, "group_").drop("group_")
    return grid.join(totals.select("taxon", "label", "abundance"), ["taxon", "label"], "left").fillna(0.0, ["abundance"])


def centred_log_ratio(cells: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """ln(x + pseudocount) less its mean over the taxa of the sample, per threshold."""
    logged = F.log(F.col("abundance") + pseudocount)
    return cells.withColumn("clr", logged - F.avg(logged).over(Window.partitionBy("threshold", "label")))


def group_log_ratios(totals: DataFrame, prevalent: DataFrame, samples: DataFrame, groups: DataFrame, pseudocount: float = 0.5) -> DataFrame:
    """``(*samples, functional_group, v)``: the mean centred log-ratio of every group's taxa in every sample, without the grid of samples x taxa.

    ``prevalent`` is ``(taxon)``, ``groups`` is ``(taxon, functional_group)``. An absent cell is ln(pseudocount), so only what is seen
    is summed: v is the group's sum of ln(x / pseudocount + 1) over its taxa less the sample's over all taxa.
    """
    above = totals.join(prevalent, "taxon", "left_semi").select("taxon", "label", F.log(F.coalesce("abundance", F.lit(0.0)) / pseudocount + 1).alias("x"))
    all_taxa = prevalent.agg(F.count(F.lit(1)).alias("n_taxa"))
    # One row, and a row per group.
    sizes = groups.join(prevalent, "taxon", "left_semi").groupBy("functional_group").agg(F.count(F.lit(1)).alias("n_group")).crossJoin(F.broadcast(all_taxa))
    own = above.join(groups, "taxon").groupBy("label", F.col("functional_group").alias("group_")).agg(F.sum("x").alias("own"))
    whole = above.groupBy(F.col("label").alias("label_")).agg(F.sum("x").alias("whole"))
    grid = samples.crossJoin(F.broadcast(sizes)).join(whole, F.col("label") == F.col("label_"), "left")
    grid = grid.join(own.withColumnRenamed("label", "of_"), (F.col("label") == F.col("of_")) & F.col("functional_group").eqNullSafe(F.col("group_")), "left")
    v = F.coalesce("own", F.lit(0.0)) / F.col("n_group") - F.coalesce("whole", F.lit(0.0)) / F.col("n_taxa")
    return grid.select(*[samples[c] for c in samples.columns], "functional_group", v.alias("v"))


def check_centred(clr: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Per threshold the largest absolute sample mean; raises if it exceeds the tolerance."""
    worst = clr.groupBy("threshold", "label").agg(F.abs(F.avg("clr")).alias("m")).groupBy("threshold").agg(F.max("m").alias("worst"))
    bad = worst.where(F.col("worst") > tolerance).limit(1).collect()
    if bad:
        raise ValueError(f"log-ratios are not centred: {bad[0].asDict()}")
    return worst


def taxon_profile(clr: DataFrame, by: list[str]) -> DataFrame:
    """Column statistics over the samples of a group."""
    return clr.groupBy(*by).agg(
        F.avg("clr").alias("mean_clr"),
        F.stddev_samp("clr").alias("sd_clr"),
        F.avg(F.abs("clr")).alias("mean_abs_clr"),
        F.max(F.abs("clr")).alias("max_abs_clr"),
        F.avg((F.col("abundance") > 0).cast("double")).alias("prevalence"),
        F.avg("abundance").alias("mean_abundance"),
    )
