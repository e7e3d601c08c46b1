"""Quality classifier by Bradley-Terry pairwise ranking.

Preference pairs (a text labelled good beats a text labelled bad) are fitted by logistic loss on
feature differences without an intercept, which is the Bradley-Terry likelihood for scores linear
in the features. The accept threshold is a quantile of the scores of labelled training texts.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.operators import ordered
from varve.operators.staging import Workspace

#: The score at the threshold: a text at the threshold quantile scores exactly this.
ACCEPT = 0.7

FEATURES = (
    "log_words", "word_chars", "distinct_words", "repeated_windows", "symbols", "bars", "exclaims", "digits",
    "upper", "non_letters", "short_words", "long_words", "line_words", "repeated_lines", "compression",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_OTHER = bytes(b for b in range(33, 128) if not chr(b).isalnum())


def features(text: str | None) -> list[float]:
    """Measurements of one whole text, each bounded or logarithmic; a null or empty text gives zeros."""
    if not text or not (words := text.split()):
        return [0.0] * len(FEATURES)
    data = text.encode()
    n, size = len(words), len(data)
    count = lambda drop: len(data) - len(data.translate(None, drop))
    lines = [line for line in text.split("\n") if line.strip()]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    windows = max(n - 2, 1)
    chars = int(lengths.sum())
    return [
        math.log1p(n),
        min(chars / n, 30.0),
        len(set(words)) / n,
        1 - len(set(zip(words, words[1:], words[2:]))) / windows if n > 2 else 0.0,
        min(count(b"#*$%&<>") / n, 2.0),
        min(data.count(b"|") / n, 2.0),
        min(data.count(b"!") / n, 2.0),
        count(_DIGITS) / size,
        count(_UPPER) / size,
        count(_OTHER) / size,
        float((lengths <= 3).mean()),
        float((lengths > 12).mean()),
        math.log1p(n / len(lines)),
        1 - len(set(lines)) / len(lines),
        min(len(zlib.compress(data, 1)) / size, 2.0),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def features_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in texts:
        yield pd.Series([features(t) for t in series])


@dataclass(frozen=True)
class PairwiseRanker:
    """Weights of the linear score and the raw score at the threshold quantile."""

    weights: tuple[float, ...]
    threshold: float

    def score_measured(self, f: Column) -> Column:
        """As ``score``, from the features of the text."""
        z = _raw(f, self.weights) - self.threshold + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))

    def score(self, text: Column) -> Column:
        """A double from 0 to 1 that grows with the raw score and is ACCEPT at the threshold."""
        weights, threshold, shift = np.array(self.weights), self.threshold, math.log(ACCEPT / (1 - ACCEPT))

        @F.pandas_udf(T.DoubleType())
        def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in texts:
                raw = np.array([features(t) for t in series]).reshape(-1, len(weights)) @ weights
                yield pd.Series(1 / (1 + np.exp(-np.clip(raw - threshold + shift, -500, 500))))

        return apply(text)


def is_held_out(doc_id: Column) -> Column:
    """True for the fold kept out of training: crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ws: Workspace | None = None) -> DataFrame:
    """``(doc_id, f)``, stored: the features of every whole text, so that each is measured once."""
    ws = ws or Workspace(docs.sparkSession, "quality")
    return ws.table(docs.select(F.col(doc_id).alias(doc_id), features_of(text).alias("f")), "measured")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    n_pairs: int = 60_000,
    reg: float = 1e-3,
) -> PairwiseRanker:
    """As ``fit_measured`` on the texts themselves."""
    ws = Workspace(docs.sparkSession, "quality")
    return fit_measured(measured(docs, doc_id, text, ws), labels, doc_id, label, n_pairs, reg, ws)


def fit_measured(
    features: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    label: str = "quality",
    n_pairs: int = 60_000,
    reg: float = 1e-3,
    ws: Workspace | None = None,
) -> PairwiseRanker:
    """Fit on all labelled texts outside the held-out fold, from stored ``(doc_id, f)``.

    Every text of the larger class stands in one pair at least, and in as many more as give ``n_pairs`` in all; those of the
    smaller class stand in more. So the pairs grow with the labelled texts, not with their square.
    Rows with a null id or label are ignored; repeated labels of an id count once (the largest).
    Without both labels there is nothing to rank: all weights are 0 and every text scores ACCEPT.
    """
    ws = ws or Workspace(features.sparkSession, "quality")
    marked = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("id_"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    training = features.select(F.col(doc_id).alias("id_"), "f").join(marked, "id_")
    # By a hash of the id, so that pairs do not follow the order of the ids.
    ranked = ordered.positions(training.withColumn("h_", F.xxhash64("id_")), [F.col("h_"), F.col("id_")], ["label"], "place", ws)
    ranked = ws.table(ranked.select("label", "f", "place"), "ranked")
    counts = {r["label"]: r["n"] for r in ranked.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        return PairwiseRanker((0.0,) * len(FEATURES), 0.0)
    larger = max(good, bad)
    rounds = -(-n_pairs // larger)
    winner = ranked.where("label = 1").select(F.col("place").alias("w"), F.col("f").alias("fw"))
    loser = ranked.where("label = 0").select(F.col("place").alias("l"), F.col("f").alias("fl"))
    # Round by round all of the larger class, the other one moved on by a share of it; a pair and its mirror image alternate, so both outcomes occur.
    turn = (F.expr(f"id div {larger}") * (bad // rounds + 1)).cast("long")
    pairs = (
        features.sparkSession.range(rounds * larger)
        .select((F.col("id") % larger % good).alias("w"), ((F.col("id") % larger + turn) % bad).alias("l"), (F.xxhash64("id") % 2 == 0).cast("int").alias("flip"))
        .join(winner, "w")
        .join(loser, "l")
    )
    sign = 1 - 2 * F.col("flip")
    differences = ws.table(pairs.select((1 - F.col("flip")).cast("double").alias("label"), F.zip_with("fw", "fl", lambda a, b: sign * (a - b)).alias("d")), "differences")
    model = LogisticRegression(fitIntercept=False, regParam=reg, maxIter=60).fit(differences.select("label", array_to_vector("d").alias("features")))
    weights = tuple(float(w) for w in model.coefficients)
    share = bad / (good + bad)
    # The quantile that leaves the training share of bad texts below, taken on both sides of the step between the classes.
    low, high = _quantiles(ranked.select("label", "place", _raw(F.col("f"), weights).alias("raw")), [max(share - 0.01, 0.0), min(share + 0.01, 1.0)], good + bad, ws)
    return PairwiseRanker(weights, (low + high) / 2)


def _raw(f: Column, weights: tuple[float, ...]) -> Column:
    return F.aggregate(F.zip_with(f, F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _quantiles(scored: DataFrame, shares: list[float], n: int, ws: Workspace) -> list[float]:
    """Exact quantiles of ``raw`` over n rows, between the two values next to each; only these values reach the driver."""
    wanted = [p * (n - 1) for p in shares]
    ends = sorted({e for x in wanted for e in (math.floor(x), math.ceil(x))})
    placed = ordered.positions(scored, [F.col("raw"), F.col("label"), F.col("place")], name="at_", ws=ws)
    value = {r["at_"]: r["raw"] for r in placed.where(F.col("at_").isin(ends)).select("at_", "raw").collect()}
    return [value[math.floor(x)] + (x - math.floor(x)) * (value[math.ceil(x)] - value[math.floor(x)]) for x in wanted]
