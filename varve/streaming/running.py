"""Fixed-width bins and state switches over streams, with watermarks and late rows.

Every trigger writes what has changed to a folder of its own, replaced if the trigger runs again, so a result read from them
is right after a restart from the checkpoint. An extension: batch counterparts are the queries of bins and of switches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pandas.api.types import union_categoricals
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What is kept of a group of keys, as Arrow streams: of every key the last settled state, rows and switches up to it and the number of
#: its waiting rows; and those rows, which others may still precede, by key.
STATE = "keys binary, rows binary"
#: Null times and ids come last, as in SQL.
LAST = 2**63 - 1


def _packed(frame: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(frame, preserve_index=False).replace_schema_metadata()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().to_pandas()


def binned(events: DataFrame, time: str, width: str, delay: str, by: list[str], value: str) -> DataFrame:
    """``(bin, *by, n, total)`` per bin of event time: rows later than ``delay`` behind the newest are dropped. Use update mode."""
    rows = events.withWatermark(time, delay).groupBy(F.window(time, width), *by)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("bin"), *by, "n", "total")


def switches(events: DataFrame, key: str, time: str, row_id: str, state: str, delay: str, groups: int = 1024) -> DataFrame:
    """``(key, n_rows, switches)`` of the states of every key in the order of time, then of ``row_id``. Use update mode.

    Rows wait in the state until the watermark passes them, as an earlier one may still come; they count in what is
    told meanwhile. So a key holds no more rows than arrive within ``delay``. A null key is a key, null states are states.

    Keys share ``groups`` states by hash, since a call for a group costs milliseconds however few rows it has: a trigger
    calls at most that many and writes the groups that it touches. Null keys have a group of their own.
    """

    def update(group: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches), ignore_index=True)
        if group[0] < 0:
            new["key"] = pd.Series([None] * len(new), dtype=object)
        if kept.exists:
            keys, rows = (_unpacked(data) for data in kept.get)
        else:
            keys = pd.DataFrame({"key": new["key"].iloc[:0], "last": [], "n": [], "changed": [], "waiting": []}).astype({"n": "int64", "changed": "int64", "waiting": "int64"})
            rows = new.iloc[:0]
        # Keys and states as numbers: known keys keep their places, a null state is -1.
        at, names = pd.factorize(pd.concat([keys["key"], new["key"]], ignore_index=True) if len(keys) else new["key"], use_na_sentinel=False)
        known = union_categoricals([pd.Categorical(column.astype(object)) if column.dtype != "category" else column.array for column in (keys["last"], rows["state"], new["state"])])
        codes, grown = known.codes, len(names) - len(keys)
        last, (n, changed) = np.append(codes[: len(keys)], np.full(grown, -1, codes.dtype)), (np.append(keys[c].to_numpy(), np.zeros(grown, np.int64)) for c in ("n", "changed"))
        arrived = at[len(keys) :]
        who = np.append(np.repeat(np.arange(len(keys)), keys["waiting"].to_numpy()), arrived)
        times, ids = (np.append(rows[c].to_numpy(np.int64), new[c].to_numpy(np.int64)) for c in ("time", "row_id"))
        order = np.lexsort((ids, times, who))
        who, times, ids, codes = who[order], times[order], ids[order], codes[len(keys) :][order]

        first = np.append(True, who[1:] != who[:-1])[: len(who)]
        before = np.append(-1, codes[:-1])[: len(codes)]
        before[first] = last[who[first]]
        switched = (codes != before) & ~(first & (n[who] == 0))
        touched = np.unique(arrived)
        if len(touched):
            rows_of, switches_of = (np.bincount(w, minlength=len(names)) for w in (who, who[switched]))
            yield pd.DataFrame({"key": names[touched], "n_rows": (n + rows_of)[touched], "switches": (changed + switches_of)[touched]})

        done = times <= kept.getCurrentWatermarkMs() * 1000
        n += np.bincount(who[done], minlength=len(names))
        changed += np.bincount(who[done & switched], minlength=len(names))
        last[who[done]] = codes[done]  # the last of a key stays
        rest = pd.DataFrame({"time": times[~done], "row_id": ids[~done], "state": pd.Categorical.from_codes(codes[~done], dtype=known.dtype).remove_unused_categories()})
        of_keys = {"key": names, "last": pd.Categorical.from_codes(last, dtype=known.dtype).remove_unused_categories(), "n": n, "changed": changed}
        kept.update((_packed(pd.DataFrame(of_keys | {"waiting": np.bincount(who[~done], minlength=len(names))})), _packed(rest)))
        if len(rest):
            kept.setTimeoutTimestamp(max(int(rest["time"].min()) // 1000 + 1, kept.getCurrentWatermarkMs() + 1))

    group = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(groups)))
    in_order = {"time": F.unix_micros(time), "row_id": F.col(row_id).cast("long")}
    rows = events.withWatermark(time, delay).select(
        group.cast("int").alias("group"), F.col(key).alias("key"), F.col(time), *(F.coalesce(c, F.lit(LAST)).alias(name) for name, c in in_order.items()), F.col(state).cast("string").alias("state")
    )
    kind = dict(events.dtypes)[key]
    return rows.groupBy("group").applyInPandasWithState(update, f"key {kind}, n_rows long, switches long", STATE, "update", GroupStateTimeout.EventTimeTimeout)


def run(stream: DataFrame, folder: str) -> None:
    """Work through what there is now; what a trigger tells goes to a folder of its own below ``folder``."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/told/batch={number}")

    started = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(put).trigger(availableNow=True).start()
    started.awaitTermination()


def newest(told: DataFrame, keys: list[str]) -> DataFrame:
    """Of every key the row that the last trigger told."""
    rest = [c for c in told.columns if c not in (*keys, "batch")]
    return told.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
