"""The views that commands give of records and results: by file, function and category, with paths below a root."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoscope.functions.text import layer_of
from lithoscope.operators import lookup


def below(rows: DataFrame, root: str, column: str = "path") -> DataFrame:
    """Paths relative to ``root``; others stay as they are."""
    start = root.rstrip("/") + "/"
    return rows.withColumn(column, F.when(F.col(column).startswith(start), F.substr(F.col(column), F.lit(len(start) + 1))).otherwise(F.col(column)))


def of_file(rows: DataFrame, file: str | None, column: str = "path") -> DataFrame:
    """The rows of one file, or all."""
    return rows if file is None else rows.where(F.col(column) == file)


def file_graph(edges: DataFrame, file: str) -> DataFrame:
    """``direction, path``: the files that one file imports, and those that import it."""
    inner = edges.where(F.col("dst").isNotNull())
    out = inner.where(F.col("src") == file).select(F.lit("imports").alias("direction"), F.col("dst").alias("path"))
    return out.unionByName(inner.where(F.col("dst") == file).select(F.lit("imported by").alias("direction"), F.col("src").alias("path"))).distinct()


def of_category(patterns: DataFrame, category: str | None) -> DataFrame:
    return patterns if category is None else patterns.where(F.col("category") == category)


def by_category(patterns: DataFrame) -> DataFrame:
    """``category, n``: only categories that occur."""
    return patterns.groupBy("category").agg(F.count("*").alias("n"))


def layer_patterns(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """``layer, n_files, patterns``: a layer's files and the distinct patterns with a place in one of them."""
    placed = files.select("file_path", layer_of(F.col("file_path")).alias("layer"))
    found = placed.join(patterns.select("file_path", "pattern").distinct(), "file_path", "left")
    return found.groupBy("layer").agg(F.count_distinct("file_path").alias("n_files"), F.sort_array(F.collect_set("pattern")).alias("patterns"))


def top(rows: DataFrame, by: str | None, order: list, n: int = 5) -> DataFrame:
    """The first ``n`` rows, of each value of ``by`` if it is given, with their ``place`` from 1."""
    if by is None:
        first = rows.orderBy(*order).limit(n)
        return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= n)


def contexts(references: DataFrame) -> DataFrame:
    """``context, n`` of references."""
    return references.groupBy("context").agg(F.count("*").alias("n"))


def discover_search(units: DataFrame, params: list[str] | None = None, returns: str | None = None, param_count: int | None = None,
                    kind: str | None = None, has_member: str | None = None, is_async: bool = False, name: str | None = None) -> DataFrame:
    """Units by the conditions of a search command. If any condition on the signature is given, the others don't count;
    a flag that is not set is no condition (``is_async`` false doesn't ask for synchronous ones)."""
    if params or returns or param_count is not None:
        return lookup.search_signature(units, params, param_count, returns)
    return lookup.search_pattern(units, units, kind=kind, has_member=has_member, is_async=True if is_async else None, name_pattern=name)
