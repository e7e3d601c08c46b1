"""Sweeps over combinations of parameters: failures stay with their combination, finished results are used again.

Each combination has a folder; a manifest beside them, to which every run appends, says with which parameters and input files
a result was made. A result is used again if the newest entry of its combination tells of success with the same parameters
and inputs and its files are still complete.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Relative difference up to which two numbers count as equal.
TOLERANCE = 1e-8
STATUS = "run long, name string, status string, parameters string, inputs string, n_rows long, message string"


@dataclass(frozen=True)
class Combination:
    """A name that can be a folder, and parameters that JSON can hold."""

    name: str
    parameters: dict


def same_parameters(a: dict, b: dict, tolerance: float = TOLERANCE) -> bool:
    """Equal keys and values; fractions within a relative tolerance, whole numbers, flags and texts exactly.

    >>> same_parameters({"k": 3, "cut": 0.25}, {"k": 3, "cut": 0.25 + 1e-12}), same_parameters({"k": 3}, {"k": 4})
    (True, False)
    """

    def same(x: object, y: object) -> bool:
        if isinstance(x, float) or isinstance(y, float):
            numbers = all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in (x, y))
            return numbers and abs(x - y) <= tolerance * max(1.0, abs(x), abs(y))
        if isinstance(x, dict) and isinstance(y, dict):
            return same_parameters(x, y, tolerance)
        if isinstance(x, list) and isinstance(y, list):
            return len(x) == len(y) and all(map(same, x, y))
        return type(x) is type(y) and x == y

    return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)


def inventory_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Number, bytes and a hash of the names, sizes and times of all files below the paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "length", "modificationTime")
    seen = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.expr("bit_xor(xxhash64(path, length, modificationTime))").alias("x")).first()
    return f"{seen.n}:{seen.bytes}:{seen.x}"


class Sweep:
    """Results of combinations below one folder, which all machines reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def manifest(self) -> DataFrame:
        """Every entry of every run."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], STATUS)
        return self.spark.read.schema(STATUS).json(f"{self.folder}/manifest")

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/results/{name}")

    def run(self, combinations: list[Combination], build: Callable[[dict], DataFrame], inputs: list[str], force: bool = False) -> DataFrame:
        """Build what cannot be used again, one combination after the other; ``(run, name, status, parameters, inputs, n_rows, message)`` of this run.

        Status is ``computed``, ``reused`` or ``failed`` with the first line of what went wrong; a failure leaves an earlier
        result of that combination alone and does not stop the others.
        """
        before = self.manifest()
        newest = before.groupBy("name").agg(F.max_by(F.struct("status", "parameters", "inputs", "n_rows"), "run").alias("e")).select("name", "e.*")
        known = {r.name: r for r in newest.where(F.col("name").isin([c.name for c in combinations])).collect()}  # a row per combination asked for
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        seen = inventory_fingerprint(self.spark, inputs)
        entries = []
        for c in combinations:
            text = json.dumps(c.parameters, sort_keys=True)
            old = known.get(c.name)
            fits = old is not None and old.status in ("computed", "reused") and old.inputs == seen and same_parameters(json.loads(old.parameters), c.parameters)
            if fits and not force and self._exists(f"results/{c.name}/_SUCCESS"):
                entries.append((run, c.name, "reused", text, seen, old.n_rows, None))
                continue
            try:
                build(c.parameters).write.mode("overwrite").parquet(f"{self.folder}/results/{c.name}.part")
                self._replace(c.name)
                entries.append((run, c.name, "computed", text, seen, self.result(c.name).count(), None))
            except Exception as error:  # noqa: BLE001  whatever stops one combination is reported, not raised
                line = traceback.format_exception_only(error)[-1].strip().split("\n")[0]
                entries.append((run, c.name, "failed", text, seen, None, line[:300]))
        table = self.spark.createDataFrame(entries, STATUS)
        table.coalesce(1).write.mode("append").json(f"{self.folder}/manifest")
        return table

    def _replace(self, name: str) -> None:
        """A finished result takes the place of the one before."""
        part, files = self._path(f"results/{name}.part")
        target, _ = self._path(f"results/{name}")
        files.delete(target, True)
        if not files.rename(part, target):
            raise OSError(f"cannot rename {part}")
