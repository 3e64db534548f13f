"""Stage outputs and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Distances between sensors on the grid, as exported: all five columns named.
EDGE_SCHEMA = "core_1 string, core_2 string, start_time string, end_time string, logical_grid_distance int"
TOPOLOGY_SCHEMA = "core_id string, start_time string, end_time string, transformer string, feeder string"


def write_parquet(df: DataFrame, path: str, *, compression: str = "gzip", partition_by: Sequence[str] = (), max_records: int = 0) -> None:
    """Overwrite a Parquet table. Files are bounded by ``max_records``, never
    gathered into one."""
    writer = df.write.mode("overwrite").option("compression", compression)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite a CSV folder with headers; nested columns must be JSON text."""
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def nested_to_json(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Arrays and structs as JSON text."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    names = cols or [f.name for f in df.schema if isinstance(f.dataType, nested)]
    return df.withColumns({c: F.to_json(c) for c in names})


def nested_from_json(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """The inverse, with the type of each column declared."""
    return df.withColumns({c: F.from_json(c, s) for c, s in schemas.items()})


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    """A typed table without rows."""
    return spark.createDataFrame([], schema)


def head_to_pandas(df: DataFrame, n: int):
    """The first ``n`` rows on the driver, for a notebook."""
    return df.limit(n).toPandas()
