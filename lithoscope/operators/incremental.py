"""Incremental indexes: rows are reused if path and time agree, others are made anew, rows of gone files drop out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2


def split(found: DataFrame, snapshot: DataFrame, path: str = "path", stamp: str = "mtime_ms") -> tuple[DataFrame, DataFrame]:
    """Rows of ``snapshot`` that still hold, and rows of ``found`` that have to be made."""
    keys = [path, stamp]
    return snapshot.join(found.select(*keys), keys, "left_semi"), found.join(snapshot.select(*keys), keys, "left_anti")


def refreshed(found: DataFrame, snapshot: DataFrame, make, path: str = "path", stamp: str = "mtime_ms") -> DataFrame:
    """The new snapshot; ``make`` turns rows of ``found`` into rows of a snapshot."""
    hits, misses = split(found, snapshot, path, stamp)
    return hits.unionByName(make(misses))


def save(index: DataFrame, path: str) -> None:
    index.write.mode("overwrite").parquet(f"{path}/version={VERSION}")


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The saved index, or an empty one if there is none of this version."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/version={VERSION}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
