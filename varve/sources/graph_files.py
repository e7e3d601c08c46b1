"""Graphs as GraphML text: part files that are one document when read in the order of their names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")]
_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">',
    '<key id="weight" for="edge" attr.name="weight" attr.type="double"/>',
    '<graph id="G" edgedefault="undirected">',
]
_TAIL = ["</graph>", "</graphml>"]


def _escaped(c: str) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), _ESCAPES, F.col(c).cast("string"))


def _unescaped(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), c)


def write_graphml(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Write ``vertices (node)`` and ``edges (src, dst, weight)`` as lines in the order head, nodes, edges, end.

    Rows without a name are left out; vertices are written once each, repeated edges as often as they are; ends of edges that are no
    vertex are added, so that the document is valid. A range shuffle orders the lines, which no task holds together.
    """
    spark = vertices.sparkSession
    kept = edges.where("src is not null and dst is not null")
    names = vertices.select("node").unionByName(kept.select(F.col("src").alias("node"))).unionByName(kept.select(F.col("dst").alias("node"))).where("node is not null").distinct()
    fixed = spark.createDataFrame([(0, i, "", line) for i, line in enumerate(_HEAD)] + [(3, i, "", line) for i, line in enumerate(_TAIL)], "section int, at int, name string, value string")
    node = names.select(F.lit(1).alias("section"), F.lit(0).alias("at"), _escaped("node").alias("name"), F.concat(F.lit('<node id="'), _escaped("node"), F.lit('"/>')).alias("value"))
    weight = F.when(F.col("weight").isNotNull(), F.concat(F.lit('<data key="weight">'), F.col("weight").cast("string"), F.lit("</data>"))).otherwise("")
    line = F.concat(F.lit('<edge source="'), _escaped("src"), F.lit('" target="'), _escaped("dst"), F.lit('">'), weight, F.lit("</edge>"))
    edge = kept.select(F.lit(2).alias("section"), F.lit(0).alias("at"), F.concat_ws("\n", "src", "dst").alias("name"), line.alias("value"))
    fixed.unionByName(node).unionByName(edge).orderBy("section", "at", "name", "value").select("value").write.text(path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(node)`` and ``(src, dst, weight)`` of files that ``write_graphml`` wrote."""
    lines = spark.read.text(path)
    node = _unescaped(F.regexp_extract("value", r'^<node id="([^"]*)"/>$', 1))
    pattern = r'^<edge source="([^"]*)" target="([^"]*)">(?:<data key="weight">([^<]*)</data>)?</edge>$'
    part = lambda i: F.regexp_extract("value", pattern, i)
    weight = F.when(part(3) != "", part(3)).cast("double")
    nodes = lines.where(F.col("value").startswith("<node ")).select(node.alias("node"))
    edges = lines.where(F.col("value").startswith("<edge ")).select(_unescaped(part(1)).alias("src"), _unescaped(part(2)).alias("dst"), weight.alias("weight"))
    return nodes, edges
