"""Intermediate tables in the folder that all machines of the cluster share.

Iterative and multi-pass operators cut their lineage by writing Parquet below
``spark.checkpoint.dir``. Losing an executor then costs a re-read, never a
recomputation from the source, and no file is left on a machine's own disk.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder with its scheme; on a local master a temporary one where none is configured."""
    global _own_dir
    sc = spark.sparkContext
    set_later = sc._jsc.sc().getCheckpointDir()
    configured = sc.getConf().get("spark.checkpoint.dir", None) or (set_later.get() if set_later.isDefined() and _own_dir is None else None)
    if configured:
        path = sc._jvm.org.apache.hadoop.fs.Path(configured)
        return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="varve-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{_own_dir}/checkpoints")
    return f"file://{_own_dir}"


class Workspace:
    """A private subfolder of the shared folder; tables in it can be dropped once superseded."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/varve/{purpose}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it back."""
        path = self.path(name)
        self.write(df, path, compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._varve_path = path
        return out

    def write(self, df: DataFrame, path: str, compression: str = "snappy") -> None:
        """Write ``df`` and let the files of its shuffles go as soon as it is written; nothing else reads them."""
        conf, key = self.spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(key)
        conf.set(key, "true")
        try:
            df.write.parquet(path, compression=compression)
        finally:
            conf.set(key, before)

    def below(self, name: str) -> Workspace:
        """A workspace inside this one, to be cleared on its own."""
        inner = Workspace(self.spark, name)
        inner.root = self.path(name)
        return inner

    def clear(self) -> None:
        """Drop all that was put below this workspace."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_varve_path", None)
            if path:
                self._delete(path)
