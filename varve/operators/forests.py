"""Random forests over samples: tuned by cross-validation, tested on held-out samples, with features eliminated module by module.

Samples are ``(id, label, x)``, ``x`` a vector with one value per feature; the number of features, not of samples, bounds what
the driver holds (names, importances). Fits are Spark ML's: bins and splits are found by sums over partitions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators import ordered
from varve.operators.links import hashed
from varve.operators.staging import Workspace

#: Share of a node's features that a split may look at: compared in tuning.
SUBSETS = ["sqrt", "onethird", "all"]


@dataclass(frozen=True)
class Forest:
    """Size of a forest and its seed; ``parallel`` fits run at the same time, ``tuning_trees`` each while values are compared."""

    trees: int = 500
    tuning_trees: int = 100
    depth: int = 8
    folds: int = 5
    seed: int = 42
    parallel: int = 4

    def classifier(self, trees: int | None = None, subset: str = "sqrt") -> RandomForestClassifier:
        return RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees or self.trees, maxDepth=self.depth, featureSubsetStrategy=subset, seed=self.seed)


def samples(values: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(id, label, x)`` and the features' names in the order of ``x``.

    ``values`` is ``(id, feature, value)``, ``labels`` is ``(id, label)``. A feature without a value (none, null, NaN) in a sample is 0 there,
    repeated values add up; samples without a label or without any value have no row, and a sample with several labels has the smallest.
    """
    good = values.where("id is not null and feature is not null and value is not null and not isnan(value)")
    names = [r[0] for r in good.select("feature").distinct().orderBy("feature").collect()]
    spark = values.sparkSession
    place = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, at int")
    found = good.join(F.broadcast(place), "feature").groupBy("id").agg(F.collect_list(F.struct("at", "value")).alias("v"))
    kind, n = found.schema["id"].dataType.simpleString(), len(names)

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.zeros((len(batch), n))
            for i, (at, value) in enumerate(zip(batch["at"], batch["value"], strict=True)):
                np.add.at(x[i], at, value)
            yield pd.DataFrame({"id": batch["id"], "a": list(x)})

    rows = found.select("id", F.col("v.at").alias("at"), F.col("v.value").cast("array<double>").alias("value")).mapInPandas(filled, f"id {kind}, a array<double>")
    one = labels.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    return rows.join(one, "id").select("id", "label", array_to_vector("a").alias("x")), names


def dealt(rows: DataFrame, share: float, folds: int, seed: int, ws: Workspace | None = None) -> DataFrame:
    """``rows`` with ``train`` (the first ceil(share * n) of a class by a hash of the id) and ``fold`` (of training rows, dealt in turn within the class)."""
    placed = ordered.positions(rows.withColumn("h_", hashed(F.lit(seed), F.col("id"))), [F.col("h_"), F.col("id")], ["label"], ws=ws)
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_"))  # a row per class
    out = placed.join(F.broadcast(sizes), "label")
    # Every fit reads these rows, in as many tasks as they are stored in.
    out = out.repartition(rows.sparkSession.sparkContext.defaultParallelism, "id")
    return out.select(*rows.columns, (F.col("position") < F.ceil(share * F.col("n_"))).alias("train"), (F.col("position") % folds).cast("int").alias("fold"))


def indexed(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """``rows`` with ``y``, the place of the label among all labels in order, and the labels."""
    classes = [r[0] for r in rows.select("label").distinct().orderBy("label").collect()]
    place: Column = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1 if classes else F.lit(None)
    return rows.withColumn("y", place.cast("double")), classes


def tuned(train: DataFrame, forest: Forest) -> tuple[RandomForestClassificationModel, str, float]:
    """The forest with the best share of features a split by accuracy over the folds (the first of equals), that share and its accuracy."""
    small = forest.classifier(forest.tuning_trees)
    grid = ParamGridBuilder().addGrid(small.featureSubsetStrategy, SUBSETS).build()
    judge = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    folds = train.agg(F.countDistinct("fold")).first()[0]
    if folds < 2:
        subset, reached = SUBSETS[0], float("nan")
    else:
        compared = CrossValidator(estimator=small, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="fold", parallelism=forest.parallel).fit(train)
        reached = max(compared.avgMetrics)
        subset = SUBSETS[compared.avgMetrics.index(reached)]
    return forest.classifier(subset=subset).fit(train), subset, reached


def quality(predicted: DataFrame) -> DataFrame:
    """``(n, accuracy, kappa)`` of ``(y, prediction)``: kappa is agreement beyond that of the margins, null where these leave no room."""
    cells = predicted.groupBy("y", "prediction").agg(F.count(F.lit(1)).alias("n"))
    margin = lambda c: cells.groupBy(F.col(c).alias("k")).agg(F.sum("n").alias(f"n_{c}"))
    chance = margin("y").join(margin("prediction"), "k").agg(F.coalesce(F.sum(F.col("n_y") * F.col("n_prediction")), F.lit(0)).cast("double").alias("both"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("y") == F.col("prediction"), F.col("n"))), F.lit(0)).alias("hit"))
    expected = F.try_divide("both", F.col("n") * F.col("n"))
    accuracy = F.try_divide("hit", "n")
    room = F.round(1 - expected, 12)
    return total.crossJoin(chance).select("n", accuracy.alias("accuracy"), F.when(room != 0, (accuracy - expected) / room).alias("kappa"))  # one row each


def importances(model: RandomForestClassificationModel, names: list[str]) -> list[tuple[str, float]]:
    """Features by falling mean decrease of impurity, equal ones by name; they sum to 1 unless no tree splits."""
    return sorted(((n, float(v)) for n, v in zip(names, model.featureImportances.toArray(), strict=True)), key=lambda r: (-r[1], r[0]))


def eliminated(fit: Callable[[list[str]], list[tuple[str, float]]], names: list[str], keep: int, drop: float = 0.25) -> list[str]:
    """The ``keep`` names that stay when the least important share ``drop`` (one at least) goes and the rest is fitted again, round by round."""
    left = sorted(names)
    while len(left) > keep:
        ranked = [n for n, _ in fit(left)]
        left = sorted(ranked[: max(keep, min(len(left) - 1, math.ceil((1 - drop) * len(left))))])
    return left


def fuzzy(train: DataFrame, names: list[str], module_of: dict[str, str], forest: Forest, screen_share: float = 0.05, selected: int = 50, drop: float = 0.25) -> tuple[RandomForestClassificationModel, list[str]]:
    """Screen every module on its own down to ``screen_share`` of it (one at least), then all survivors together down to ``selected``.

    Modules are screened side by side, ``forest.parallel`` at a time, with ``tuning_trees`` a forest; the last forest has ``trees``. Features
    without a module form one of their own. ``train`` is read in every fit, so it should be a stored table.
    """
    at = {n: i for i, n in enumerate(names)}

    def sliced(chosen: list[str]) -> DataFrame:
        # "x" gives way to its chosen values.
        cut = VectorSlicer(inputCol="all_", outputCol="x", indices=[at[n] for n in chosen])
        return cut.transform(train.select("y", F.col("x").alias("all_"))).select("y", "x")

    def fit(chosen: list[str]) -> list[tuple[str, float]]:
        return importances(forest.classifier(forest.tuning_trees).fit(sliced(chosen)), chosen)

    modules: dict[str, list[str]] = {}
    for n in names:
        modules.setdefault(module_of.get(n) or "", []).append(n)
    with ThreadPool(forest.parallel) as pool:
        survivors = pool.map(lambda m: eliminated(fit, m, max(1, math.ceil(screen_share * len(m))), drop), [modules[m] for m in sorted(modules)], chunksize=1)
    chosen = eliminated(fit, [n for part in survivors for n in part], selected, drop)
    return forest.classifier().fit(sliced(chosen)), chosen


def sliced_test(test: DataFrame, names: list[str], chosen: list[str]) -> DataFrame:
    """``test`` with only the chosen features, in their order."""
    at = {n: i for i, n in enumerate(names)}
    cut = VectorSlicer(inputCol="all_", outputCol="x", indices=[at[n] for n in chosen])
    return cut.transform(test.withColumnRenamed("x", "all_")).drop("all_")
