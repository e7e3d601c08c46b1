"""Association graphs for combinations of thresholds and methods, with isolated failures and reuse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.operators import graphs
from varve.operators.staging import Workspace
from varve.operators.sweeps import Combination, Sweep
from varve.plans.base import query
from varve.sources.domain import Domain

GRID = [Combination(f"prev_{t}-{m}", {"threshold": t, "method": m, "cutoff": 0.55}) for t in (5, 10) for m in ("pearson", "spearman")]
#: A combination whose method does not exist.
BROKEN = Combination("prev_5-unknown", {"threshold": 5, "method": "unknown", "cutoff": 0.55})
#: The first combination with another cutoff.
CHANGED = Combination(GRID[0].name, GRID[0].parameters | {"cutoff": 0.6})

_COUNTS = """ranked AS (SELECT c.threshold, m.core, c.taxon, c.label, c.clr AS pearson, rank() OVER w+(count(*) OVER (PARTITION BY c.threshold, m.core, c.taxon, c.clr)-1)/2.0 AS spearman FROM clr c JOIN meta m USING (label) WHERE c.threshold IN (5,10)
    WINDOW w AS (PARTITION BY c.threshold, m.core, c.taxon ORDER BY c.clr)),
  rs AS (SELECT a.threshold, a.core, count(*) AS n, corr(a.pearson,b.pearson) AS pearson, corr(a.spearman,b.spearman) AS spearman FROM ranked a JOIN ranked b ON a.threshold=b.threshold AND a.core=b.core AND a.label=b.label AND a.taxon<b.taxon
    GROUP BY a.threshold, a.core, a.taxon, b.taxon HAVING count(*)>=8 AND stddev_pop(a.pearson)>1e-12 AND stddev_pop(b.pearson)>1e-12),
  grid AS (SELECT t AS threshold, m AS method FROM (VALUES (5),(10)) x(t), (VALUES ('pearson'),('spearman')) y(m)),
  found AS (SELECT threshold, 'pearson' AS method, pearson AS r FROM rs UNION ALL SELECT threshold, 'spearman', spearman FROM rs)"""


def _build(d: Domain):
    def build(parameters: dict) -> DataFrame:
        if parameters["method"] not in ("pearson", "spearman", "bicor"):
            raise ValueError(f"no method {parameters['method']}")
        clr = d.clr.where(F.col("threshold") == parameters["threshold"]).join(d.meta.select("label", "core"), "label")
        return graphs.association_graph(clr, parameters["method"], parameters["cutoff"])

    return build


def _inputs(d: Domain) -> list[str]:
    return [f"{d.sf_dir}/{t}.parquet" for t in ("lineitem", "part", "supplier", "nation", "region")]


@query(
    "c02_isolated_sweep",
    f""", {_COUNTS} SELECT 'prev_'||g.threshold||'-'||g.method AS name, 'computed' AS status, count(f.r) AS edges FROM grid g LEFT JOIN found f ON f.threshold=g.threshold AND f.method=g.method AND abs(f.r)>=0.55 GROUP BY g.threshold, g.method
    UNION ALL SELECT 'prev_5-unknown', 'failed', NULL""",
)
def isolated_sweep(d: Domain):
    """Edges of every combination; one that cannot be built is told as failed and stops no other."""
    sweep = Sweep(d.spark, Workspace(d.spark, "sweep").root)
    return sweep.run([*GRID, BROKEN], _build(d), _inputs(d)).select("name", "status", F.col("n_rows").alias("edges"))


@query(
    "c03_reused_sweep",
    f""", {_COUNTS} SELECT 'prev_'||g.threshold||'-'||g.method AS name, CASE WHEN g.threshold=5 AND g.method='pearson' THEN 'computed' ELSE 'reused' END AS status, count(f.r) AS edges
    FROM grid g LEFT JOIN found f ON f.threshold=g.threshold AND f.method=g.method AND abs(f.r)>=CASE WHEN g.threshold=5 AND g.method='pearson' THEN 0.6 ELSE 0.55 END GROUP BY g.threshold, g.method""",
)
def reused_sweep(d: Domain):
    """The second run of a sweep in which one combination has another cutoff: only that one is computed again."""
    sweep = Sweep(d.spark, Workspace(d.spark, "sweep").root)
    sweep.run(GRID, _build(d), _inputs(d))
    return sweep.run([CHANGED, *GRID[1:]], _build(d), _inputs(d)).select("name", "status", F.col("n_rows").alias("edges"))
