"""Hidden states of the cores over time: choice of their number, decoded paths, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.operators import abundance
from varve.operators import hidden_states as hs
from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import PRIMARY, Domain

STATES, STARTS, VALUES, ROUNDS = [2, 3, 4, 5], 3, 3, 20
#: The core that is held out when the number of states is chosen, and the difference in BIC below which fits count as equal.
VALIDATION, AMBIGUOUS = "EUROPE", 10.0


def group_means(d: Domain, ws: Workspace) -> DataFrame:
    """``(core, age_kyr, label, functional_group, v)``, stored: the mean log-ratio of every functional group in every sample."""
    totals = ws.table(d.totals.select("taxon", "label", "abundance"), "totals")
    prevalent = abundance.prevalent_taxa(totals, [PRIMARY]).select("taxon")
    return ws.table(abundance.group_log_ratios(totals, prevalent, d.meta.select("core", "age_kyr", "label"), d.taxa.select("taxon", "functional_group").distinct()), "groups")


def observations(means: DataFrame, ws: Workspace) -> DataFrame:
    """``(core, age_kyr, label, v1, v2, v3)``: mean log-ratio of the VALUES functional groups that vary most over the samples."""
    chosen = [r[0] for r in means.groupBy("functional_group").agg(F.round(F.var_samp("v"), 9).alias("s")).orderBy(F.desc_nulls_last("s"), "functional_group").limit(VALUES).collect()]
    value = lambda g: F.coalesce(F.max(F.when(F.col("functional_group") == g, F.col("v"))), F.lit(0.0))
    chosen += [None] * (VALUES - len(chosen))
    return ws.table(means.groupBy("core", "age_kyr", "label").agg(*[value(g).alias(f"v{i + 1}") for i, g in enumerate(chosen)]), "observations")


def _chunks(rows: DataFrame, ws: Workspace) -> DataFrame:
    return hs.chunked(rows, "core", ["age_kyr", "label"], [f"v{i + 1}" for i in range(VALUES)], ws=ws)


def _best(chunks: DataFrame, states: list[int], ws: Workspace) -> dict[int, tuple[hs.Hmm, float]]:
    """For every number of states the start that ends with the largest likelihood; all are fitted in the same passes."""
    models = [m for k in states for m in hs.starts(chunks, k, STARTS, VALUES)]
    best: dict[int, tuple[hs.Hmm, float]] = {}
    for model, reached in hs.fit(chunks, models, ROUNDS, 1e-5, ws):
        if model.states not in best or reached > best[model.states][1]:
            best[model.states] = model, reached
    return best


def changes(decoded: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``(*by, n_rows, n_steps, switches)`` of states in order within ``by``; a state's first row is no step."""
    before = F.lag("state").over(Window.partitionBy(*by).orderBy(*order))
    steps = decoded.withColumn("before", before)
    return steps.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count("before").alias("n_steps"), F.sum((F.col("before") != F.col("state")).cast("long")).alias("switches"))


def selection(d: Domain, ws: Workspace, means: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The comparison of the numbers of states and the observations.

    Fits on all cores but one, their BIC, and how the core left out is explained. Of the numbers whose BIC is within AMBIGUOUS of
    the best, the one with the largest held-out likelihood per sample is chosen; ties go to fewer switches, then to the BIC.
    """
    rows = observations(group_means(d, ws) if means is None else means, ws)
    train, held = _chunks(rows.where(F.col("core") != VALIDATION), ws), _chunks(rows.where(F.col("core") == VALIDATION), ws)
    found = []
    n, n_held = hs.moments(train, VALUES)[0], hs.moments(held, VALUES)[0]
    fits = _best(train, STATES, ws) if n else {}
    likelihoods = hs.log_likelihood(held, [fits[k][0] for k in fits], ws) if n_held and fits else []
    paths = None
    for i, (k, (model, reached)) in enumerate(fits.items()):
        found.append((k, reached, model.free_parameters, likelihoods[i] if n_held else None, n, n_held))
        path = hs.decode(held, model, ws).withColumn("k", F.lit(k))
        paths = path if paths is None else paths.unionByName(path)
    table = d.spark.createDataFrame(found, "k int, log_likelihood double, parameters int, held_log_likelihood double, n long, n_held long")
    table = table.withColumn("bic", -2 * F.col("log_likelihood") + F.col("parameters") * F.log("n")).withColumn("held_per_sample", F.try_divide("held_log_likelihood", "n_held"))
    if paths is None:
        steps = d.spark.createDataFrame([], "k int, held_posterior double, held_states long, held_self_rate double, held_switches_per_100 double")
    else:
        ages = rows.select(F.col("label").alias("key"), "age_kyr")
        paths = ws.table(paths.join(ages, "key"), "paths")
        step = changes(paths, ["k", "sequence"], ["age_kyr", "key"]).groupBy("k").agg((1 - F.try_divide(F.sum("switches"), F.sum("n_steps"))).alias("held_self_rate"))
        held_ = paths.groupBy("k").agg(F.avg("posterior").alias("held_posterior"), F.countDistinct("state").alias("held_states"))
        steps = held_.join(step, "k").withColumn("held_switches_per_100", 100 * (1 - F.col("held_self_rate")))
    table = table.join(steps, "k", "left")
    table = table.withColumn("delta_bic", F.col("bic") - F.min("bic").over(Window.partitionBy(F.lit(1))))  # a row per number of states
    table = table.withColumn("ambiguous", F.col("delta_bic") <= AMBIGUOUS)
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc(F.col("ambiguous") & F.col("held_per_sample").isNotNull()), F.desc_nulls_last("held_per_sample"), F.desc_nulls_last("held_self_rate"), "bic")
    return table.withColumn("selected", F.row_number().over(order) == 1), rows


@query("m14_hmm_selection")
def hmm_selection(d: Domain):
    """Numbers of hidden states compared, and the one that is chosen."""
    table, _ = selection(d, Workspace(d.spark, "hmm"))
    numbers = ["log_likelihood", "bic", "delta_bic", "held_log_likelihood", "held_per_sample", "held_posterior", "held_self_rate", "held_switches_per_100"]
    return table.select("k", *[F.round(c, 4).alias(c) for c in numbers], "held_states", "ambiguous", "selected")


def decoded_states(d: Domain, ws: Workspace, means: DataFrame | None = None) -> DataFrame:
    """``(label, core, age_kyr, mis, sst, state, posterior, name)``: the path of every core by the chosen model, fitted to all cores.

    The state with the largest mean ``mis`` is named G-A, the others IG-B, IG-C and so on by falling means.
    """
    table, rows = selection(d, ws, means)
    chosen = table.where("selected").select("k").first()
    meta = d.meta.select("label", "core", "age_kyr", "mis", "sst")
    if chosen is None:
        return meta.limit(0).select("*", F.lit(0).alias("state"), F.lit(0.0).alias("posterior"), F.lit("").alias("name"))
    chunks = _chunks(rows, ws)
    (model, _), = _best(chunks, [chosen.k], ws).values()
    path = hs.decode(chunks, model, ws).select(F.col("key").cast("long").alias("label"), "state", "posterior")
    path = ws.table(meta.join(path, "label"), "path")
    means = path.groupBy("state").agg(F.avg("mis").alias("mean"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("mean"), "state"))  # a row per state
    names = means.withColumn("rank", rank).select("state", F.when(F.col("rank") == 1, "G-A").otherwise(F.concat(F.lit("IG-"), F.char(64 + F.col("rank")))).alias("name"))
    return path.join(F.broadcast(names), "state")


@query("m14_hmm_states")
def hmm_states(d: Domain):
    """State of every sample, with its posterior probability."""
    found = decoded_states(d, Workspace(d.spark, "hmm"))
    return found.select("core", "label", "age_kyr", "state", "name", F.round("posterior", 6).alias("posterior"))


@query("m15_state_fingerprint")
def state_fingerprint(d: Domain):
    """Per state its samples, mean covariates, mean log-ratio of every functional group, and the share of glacial samples (mis of 4 or more)."""
    ws = Workspace(d.spark, "hmm")
    means = group_means(d, ws)
    states = ws.table(decoded_states(d, ws, means), "states")
    # Every sample has the same taxa, so the mean over a group's cells is that of its samples' means.
    profile = means.join(states.select("label", "name"), "label").groupBy("name", "functional_group").agg(F.avg("v").alias("mean_clr"))
    own = states.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.avg("mis").alias("mean_mis"), F.avg("sst").alias("mean_sst"), (100 * F.avg((F.col("mis") >= 4).cast("int"))).alias("pct_glacial"))
    rounded = [F.round(c, 6).alias(c) for c in ("mean_mis", "mean_sst", "pct_glacial", "mean_clr")]
    return profile.join(own, "name").select("name", "n", "functional_group", *rounded)


@query("w12_hmm_switches")
def hmm_switches(d: Domain):
    """Steps, switches and the rate of staying of the decoded path of every core, youngest sample first."""
    ws = Workspace(d.spark, "hmm")
    found = changes(ws.table(decoded_states(d, ws), "states"), ["core"], ["age_kyr", "label"])
    stay = 1 - F.try_divide("switches", "n_steps")
    return found.select("core", "n_rows", "n_steps", F.coalesce("switches", F.lit(0)).alias("switches"), F.round(stay, 6).alias("self_transition_rate"), F.round(100 * (1 - stay), 6).alias("switches_per_100"))
