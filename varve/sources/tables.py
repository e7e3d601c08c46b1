"""Table sources and sinks: typed TSV scans, optional inputs, manifests and inventories."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tsv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """A tab-separated file (also gzipped) with a header and ``NA`` for missing; short rows are padded with nulls."""
    df = spark.read.schema(schema).options(sep="\t", header=True, nullValue="NA", mode="PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.options(sep="\t", header=True, nullValue="NA").csv(path)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail at once when a column is missing."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the given schema when the path does not exist."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], schema)


def select_present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def finite(df: DataFrame, columns: list[str], fill: float | None = None) -> DataFrame:
    """NaN and infinities become null, and null becomes ``fill`` if that is given."""
    def clean(c: str):
        x = F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c))
        return x if fill is None else F.coalesce(x, F.lit(fill))

    return df.withColumns({c: clean(c) for c in columns})


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """``(file, bytes)`` of all files below a path, without reading their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"))


def write_manifest(df: DataFrame, path: str) -> None:
    """Rows as JSON, one object per line."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.text(path)


def to_markdown(df: DataFrame, rows: int = 30) -> str:
    """The first rows as a Markdown table: numbers to four significant digits, pipes as slashes."""
    def cell(x: object) -> str:
        text = f"{x:.4g}" if isinstance(x, float) else "NA" if x is None else str(x)
        return text.replace("|", "/")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, row)) + " |" for row in df.limit(rows).collect())])
