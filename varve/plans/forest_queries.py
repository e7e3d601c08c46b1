"""Which taxa tell the hidden states apart: a random forest, and one with features eliminated module by module."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import forests
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.plans.state_queries import decoded_states
from varve.sources.domain import Domain

FOREST = forests.Forest()
TRAIN_SHARE = 0.7


class _Samples:
    """Samples with the log-ratios of all taxa and their decoded state, dealt into training and test rows, stored once."""

    def __init__(self, d: Domain):
        self.ws = ws = Workspace(d.spark, "forest")
        states = decoded_states(d, ws).select(F.col("label").alias("id"), F.col("name").alias("label"))
        rows, self.names = forests.samples(d.clr_primary.select(F.col("label").alias("id"), F.col("taxon").alias("feature"), F.col("clr").alias("value")), states)
        stored, self.classes = forests.indexed(ws.table(rows, "samples"))
        stored = ws.table(forests.dealt(stored, TRAIN_SHARE, FOREST.folds, FOREST.seed, ws), "dealt")
        self.train, self.test = stored.where("train"), stored.where("not train")

    @property
    def usable(self) -> bool:
        return bool(self.names) and len(self.classes) > 1


def judged_by(model: RandomForestClassificationModel, test: DataFrame, ws: Workspace) -> DataFrame:
    """Quality of the model on test rows, from stored predictions: no plan that reads it holds the model, whose summary cannot be sent everywhere."""
    predicted = ws.table(model.transform(test).select("y", "prediction"), "predicted")
    return forests.quality(predicted)


def _report(d: Domain, found: list[tuple[str, float]], judged: DataFrame | None, subset: str | None, reached: float | None) -> DataFrame:
    """Features by importance beside the quality on the test rows and their functional group."""
    rows = d.spark.createDataFrame([(n, v, i + 1) for i, (n, v) in enumerate(found)], "taxon string, importance double, rank int")
    rows = rows.join(d.taxa.select("taxon", "functional_group"), "taxon", "left").withColumns({"subset": F.lit(subset).cast("string"), "cv_accuracy": F.lit(reached).cast("double")})
    # One row of quality.
    judged = d.spark.createDataFrame([], "n long, accuracy double, kappa double") if judged is None else judged
    rounded = [F.round(c, 6).alias(c) for c in ("importance", "cv_accuracy", "accuracy", "kappa")]
    return rows.crossJoin(F.broadcast(judged)).select("taxon", "functional_group", "rank", "subset", F.col("n").alias("n_test"), *rounded)


@query("m12_forest_importance")
def forest_importance(d: Domain):
    """Every taxon by its importance in the tuned forest of all taxa; no row where fewer than two states are there."""
    s = _Samples(d)
    if not s.usable:
        return _report(d, [], None, None, None)
    model, subset, reached = forests.tuned(s.train, FOREST)
    return _report(d, forests.importances(model, s.names), judged_by(model, s.test, s.ws), subset, reached)


@query("m13_fuzzy_forest")
def fuzzy_forest(d: Domain):
    """The taxa that stay when every functional group is screened on its own and the survivors together, at most 50."""
    s = _Samples(d)
    if not s.usable:
        return _report(d, [], None, None, None)
    module_of = {r.taxon: r.functional_group for r in d.taxa.select("taxon", "functional_group").collect() if r.taxon in set(s.names)}
    model, chosen = forests.fuzzy(s.train, s.names, module_of, FOREST)
    return _report(d, forests.importances(model, chosen), judged_by(model, forests.sliced_test(s.test, s.names, chosen), s.ws), "sqrt", None)
