"""Registration of queries and the SQL views that their twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from varve.sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views of varve.sources.domain in SQL, in the order they build on each other.
VIEWS = {
    "samples": """SELECT s_suppkey AS label, r_name AS core, (s_suppkey*7919)%160000 AS y_bp, ((s_suppkey*7919)%160000)/1000.0::DOUBLE AS age_kyr,
      (3.1+(s_suppkey%20)/10.0)::DOUBLE AS mis, s_acctbal/1000.0::DOUBLE AS sst FROM supplier JOIN nation ON s_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey""",
    "meta": "SELECT * FROM samples WHERE core IN ('AFRICA','AMERICA','ASIA','EUROPE') AND age_kyr<=150 AND label NOT IN (13)",
    "records": """SELECT p_brand||'/'||p_type AS taxon, l_suppkey AS label, CASE WHEN l_linestatus='F' THEN 'd__Bacteria' ELSE 'd__Archaea' END AS domain,
      CASE WHEN l_returnflag='R' THEN 'Damaged' ELSE 'Intact' END AS is_dmg, l_quantity AS n_reads, CASE WHEN l_discount>=0.09 THEN l_quantity ELSE 0.0::DOUBLE END AS abundance,
      l_extendedprice AS reference_length FROM lineitem JOIN part ON l_partkey=p_partkey""",
    "taxa": "SELECT DISTINCT p_brand||'/'||p_type AS taxon, p_type AS functional_group, p_brand AS phylum FROM part",
    "totals": """SELECT taxon, label, sum(n_reads) AS n_reads, sum(abundance) AS abundance, sum(reference_length::DECIMAL(18,2))::DOUBLE/count(reference_length) AS reference_length, count(*) AS n_records
      FROM records WHERE is_dmg='Damaged' AND label IN (SELECT label FROM meta) GROUP BY ALL""",
    "prevalent": """SELECT threshold, taxon, n_samples FROM (SELECT taxon, count(*) AS n_samples FROM totals WHERE abundance>0 GROUP BY taxon),
      (VALUES (3),(5),(10)) t(threshold) WHERE n_samples>=threshold""",
    "cells": """SELECT p.threshold, p.taxon, m.label, coalesce(t.abundance,0) AS abundance FROM prevalent p CROSS JOIN meta m
      LEFT JOIN totals t ON t.taxon=p.taxon AND t.label=m.label""",
    "clr": "SELECT *, ln(abundance+0.5)-avg(ln(abundance+0.5)) OVER (PARTITION BY threshold,label) AS clr FROM cells",
    "clr5": "SELECT c.taxon, c.label, c.abundance, c.clr, m.core, m.age_kyr, m.mis, m.sst FROM clr c JOIN meta m USING (label) WHERE threshold=5",
    "corrs": """SELECT a.core, a.taxon AS src, b.taxon AS dst, count(*) AS n, corr(a.clr,b.clr) AS r FROM clr5 a JOIN clr5 b ON a.core=b.core AND a.label=b.label AND a.taxon<b.taxon
      GROUP BY ALL HAVING count(*)>=8 AND stddev_pop(a.clr)>1e-12 AND stddev_pop(b.clr)>1e-12""",
    "edges": "SELECT core, src, dst, r AS signed_weight, abs(r) AS weight FROM corrs WHERE abs(r)>=0.55",
    "links": "SELECT core, src, dst, weight FROM edges UNION ALL SELECT core, dst, src, weight FROM edges",
    "degrees": "SELECT core, src AS taxon, count(*) AS degree, sum(weight) AS strength FROM links GROUP BY ALL",
}


def with_views(sql: str) -> str:
    """``sql`` below the views."""
    body = sql.strip()
    # A query may go on with views of its own after a comma, or begin them with WITH.
    own = f" {body}" if body.startswith(",") else f", {body[5:]}" if body.startswith("WITH ") else f" {body}"
    return "WITH RECURSIVE " + ", ".join(f"{name} AS ({body})" for name, body in VIEWS.items()) + own


def query(name: str, sql: str | None = None):
    """Register a function of a :class:`Domain` under ``name``, with its SQL twin over the views."""

    def register(build: Callable[[Domain], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Domain(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return build

    return register
