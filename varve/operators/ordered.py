"""Running sums and positions over globally sorted rows, without a task that sees them all.

One range shuffle sorts the rows into partitions; sums inside a partition are a window, and what came before a partition
is a sum over one row per partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.operators.staging import Workspace


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], by: list[str] | None = None, ws: Workspace | None = None) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` over the rows of the same ``by`` up to and including the row.

    ``order`` must not leave ties among rows of a group; nulls sort as Spark sorts them. Null values count as 0.
    """
    terms = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    return _running(rows, order, terms, F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)), by, ws)


def running_least(rows: DataFrame, order: list[Column], values: dict[str, Column], by: list[str] | None = None, ws: Workspace | None = None) -> DataFrame:
    """As ``running_sums`` with the smallest value that is not null."""
    return _running(rows, order, values, F.min, F.least, by, ws)


def _running(rows: DataFrame, order: list[Column], terms: dict[str, Column], fold: Callable, joined: Callable, by: list[str] | None, ws: Workspace | None) -> DataFrame:
    ws = ws or Workspace(rows.sparkSession, "ordered")
    by = by or []
    group = [F.col(c) for c in by]
    # The sample that finds the ranges reads the rows once more, so they are stored first.
    stored = ws.table(rows.withColumns({f"{n}_": c for n, c in terms.items()}), "terms")
    dealt = ws.table(stored.repartitionByRange(*group, *order).withColumn("part_", F.spark_partition_id()), "dealt")
    ws.drop(stored)
    totals = dealt.groupBy("part_", *by).agg(*[fold(f"{n}_").alias(n) for n in terms])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    before = ws.table(totals.select(F.col("part_").alias("earlier_part_"), *[F.col(c).alias(f"{c}_earlier_") for c in by], *[fold(n).over(earlier).alias(f"{n}_before") for n in terms]), "before")
    same = F.col("part_") == F.col("earlier_part_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_earlier_"))
    own = Window.partitionBy("part_", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(before, same)
    return out.select(*rows.columns, *[joined(fold(f"{n}_").over(own), F.col(f"{n}_before")).alias(n) for n in terms])


def positions(rows: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position", ws: Workspace | None = None) -> DataFrame:
    """``rows`` numbered from 0 in ``order`` within each ``by``."""
    return running_sums(rows, order, {name: F.lit(1).cast("long")}, by, ws).withColumn(name, F.col(name) - 1)


def ranking_quality(scored: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "score") -> DataFrame:
    """``(*by, n_positive, n_negative, auc, average_precision)`` of scores of 0/1 labels, equal scores counted as ties.

    The area is that of Mann and Whitney; average precision sums precision times gain in recall over the distinct
    scores from the highest down. Both are null without positives, the area also without negatives.
    """
    by = by or []
    steps = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s_")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("p_"), F.sum((F.col(label) != 1).cast("long")).alias("q_")
    )
    run = running_sums(steps, [F.desc("s_")], {"positives": F.col("p_"), "negatives": F.col("q_")}, by)
    above = F.col("positives") - F.col("p_")  # positives with a higher score
    wins = F.sum(F.col("q_") * (above + F.col("p_") / 2))
    precise = F.sum(F.col("p_") * F.col("positives") / (F.col("positives") + F.col("negatives")))
    out = run.groupBy(*by).agg(F.sum("p_").alias("n_positive"), F.sum("q_").alias("n_negative"), wins.alias("w_"), precise.alias("a_"))
    return out.select(*by, "n_positive", "n_negative", F.try_divide("w_", F.col("n_positive") * F.col("n_negative")).alias("auc"), F.try_divide("a_", "n_positive").alias("average_precision"))
