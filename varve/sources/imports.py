"""Import of files into a folder of one's own: copied only if their size changed, with a table of what came from where."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNK = 8 << 20


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; Hadoop writes local ones with one slash."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _copy(source: str, destination: str) -> tuple[int, bool]:
    """Bytes of the source, and whether it was copied; the copy takes its name only once it is whole, so a task may run again."""
    from_fs, path = _located(source)
    to_fs, to_path = _located(destination)
    size = from_fs.get_file_info(path).size
    if size is None:
        raise FileNotFoundError(f"no file {source}")
    if to_fs.get_file_info(to_path).size == size:
        return size, False
    to_fs.create_dir(to_path.rsplit("/", 1)[0], recursive=True)
    part = f"{to_path}.{TaskContext.get().taskAttemptId()}.part"
    with from_fs.open_input_stream(path) as read, to_fs.open_output_stream(part) as write:
        while chunk := read.read(_CHUNK):
            write.write(chunk)
    to_fs.move(part, to_path)
    return size, True


def import_files(spark: SparkSession, files: list[tuple[str, list[str]]], folder: str) -> DataFrame:
    """Copy Parquet files, each with the columns it must have, into ``folder``; every file is copied in one task, piece by piece.

    Returns ``(source, destination, bytes, required_columns, present, copied, imported_at)``, computed anew only by reading it again,
    so store it. Sources are single files. A missing file or column raises: the file at once in its task, the column before anything is copied.
    """
    for source, required in files:
        missing = [c for c in required if c not in spark.read.parquet(source).columns]
        if missing:
            raise ValueError(f"{source} lacks columns: {', '.join(missing)}")
    rows = [(i, s, f"{folder.rstrip('/')}/{s.rsplit('/', 1)[-1]}", ", ".join(required)) for i, (s, required) in enumerate(files)]
    listed = spark.createDataFrame(rows, "i int, source string, destination string, required_columns string").repartition(max(len(rows), 1), "i")

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [_copy(s, t) for s, t in zip(batch["source"], batch["destination"])]
            yield batch.drop(columns="i").assign(bytes=[b for b, _ in done], copied=[c for _, c in done])

    found = listed.mapInPandas(copied, "source string, destination string, required_columns string, bytes long, copied boolean")
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss z")
    return found.select("source", "destination", "bytes", "required_columns", F.lit(True).alias("present"), "copied", stamp.alias("imported_at"))
