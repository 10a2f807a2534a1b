"""Counts over units and graphs, and inverted indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_kind(units: DataFrame, kind: str = "kind") -> DataFrame:
    return units.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def index_stats(files: DataFrame, units: DataFrame) -> DataFrame:
    """One row: units, exported units, and files, those without units too."""
    each = units.agg(F.count("*").alias("units"), F.count_if("exported").alias("exported")).withColumn("one", F.lit(1))
    return each.join(files.agg(F.count_distinct("path").alias("files")).withColumn("one", F.lit(1)), "one").drop("one")


def inverted(rows: DataFrame, names: str, row_id: str) -> DataFrame:
    """``name, files``: distinct ids for each element of the array ``names``, sorted."""
    return rows.select(F.col(row_id), F.explode(names).alias("name")).groupBy("name").agg(F.sort_array(F.collect_set(row_id)).alias("files"))


def frequencies(rows: DataFrame, names: str, row_id: str) -> DataFrame:
    """``name, n_rows``: in how many rows each element occurs; a count, so that a frequent name stays one number."""
    return rows.select(F.col(row_id), F.explode(F.array_distinct(names)).alias("name")).groupBy("name").agg(F.count("*").alias("n_rows"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row over ``edges(src, dst, source)``; a null ``dst`` is external. Repeated edges count."""
    return edges.agg(
        F.count_distinct("src").alias("modules"), F.count_if(F.col("dst").isNotNull()).alias("internal_edges"),
        F.count_distinct(F.when(F.col("dst").isNull(), F.col("source"))).alias("external_sources"),
    )


def error_report(errors: DataFrame) -> DataFrame:
    """Counts by severity; fatal ones are errors too."""
    return errors.agg(F.count_if(F.col("severity").isin("error", "fatal")).alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("total"))
