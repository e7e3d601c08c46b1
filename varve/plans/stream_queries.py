"""Bins and switches over the events as a stream that arrives in shuffled files. An extension beyond the reference."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.operators.staging import Workspace
from varve.plans.base import query
from varve.sources.domain import Domain
from varve.streaming import running

#: However many files the writer makes of it, the stream is worked through in as many triggers.
FILES, TRIGGERS = 8, 3
#: Longer than the span of the events, which arrive in no order: none is late.
DELAY = "400 days"


def _arriving(d: Domain, ws: Workspace) -> DataFrame:
    """The events dealt into files by a hash, read as a stream of a few files per trigger."""
    path = ws.path("arriving")
    rows = d.table("events").withColumn("at", F.col("ts").cast("timestamp"))
    rows.repartition(FILES, F.xxhash64("event_id")).write.parquet(path)
    files = len(d.spark.read.schema(rows.schema).parquet(path).inputFiles())
    return d.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, math.ceil(files / TRIGGERS))).parquet(path)


def _told(d: Domain, ws: Workspace, stream: DataFrame, keys: list[str]) -> DataFrame:
    folder = ws.path("stream")
    running.run(stream, folder)
    return running.newest(d.spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).option("basePath", f"{folder}/told").parquet(f"{folder}/told"), keys)


@query(
    "o10_streamed_bins",
    "SELECT (epoch_us(ts)//21600000000)*6 AS bin_hour, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL",
)
def streamed_bins(d: Domain):
    """Events per six hours and type, summed while they arrive."""
    ws = Workspace(d.spark, "bins")
    found = _told(d, ws, running.binned(_arriving(d, ws), "at", "6 hours", DELAY, ["event_type"], "value"), ["bin", "event_type"])
    return found.select(F.expr("unix_micros(bin) div 3600000000").alias("bin_hour"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "w12_streamed_switches",
    """SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE r>1 AND event_type IS DISTINCT FROM b) AS switches
    FROM (SELECT user_id, event_type, lag(event_type) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY user_id""",
)
def streamed_switches(d: Domain):
    """Rows and changes of event type of every user, in the order of time whatever the order of arrival."""
    ws = Workspace(d.spark, "switches")
    found = _told(d, ws, running.switches(_arriving(d, ws), "user_id", "at", "event_id", "event_type", DELAY), ["key"])
    return found.select(F.col("key").alias("user_id"), "n_rows", "switches")
