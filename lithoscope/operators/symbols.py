"""Symbol indexes and import graphs as tables that grow by union: what definitions and references a name has, by file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(extracted: DataFrame) -> DataFrame:
    """``file_path, name, role``: top-level definitions, and names that a file imports by name. Duplicates stay."""
    defined = extracted.select(F.col("path").alias("file_path"), F.explode("top_level").alias("t")).select("file_path", "t.name", F.lit("definition").alias("role"))
    used = extracted.select(F.col("path").alias("file_path"), F.explode("imports").alias("i")).select("file_path", F.explode("i.specifiers").alias("name"), F.lit("reference").alias("role"))
    return defined.unionByName(used.where(~F.col("name").isin("*", "default")))


def add_symbols(symbols: DataFrame, more: DataFrame) -> DataFrame:
    """A multimap: every row stays."""
    return symbols.unionByName(more)


def definitions_of(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where((F.col("name") == name) & (F.col("role") == "definition")).select("file_path", "name")


def references_of(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where((F.col("name") == name) & (F.col("role") == "reference")).select("file_path", "name")


def add_entry(edges: DataFrame, entry: DataFrame) -> DataFrame:
    """An import graph with one more file's ``src, dst``: its earlier edges go, and an edge stands there once."""
    files = entry.select("src").distinct()
    return edges.join(files, "src", "left_anti").select("src", "dst").unionByName(entry.select("src", "dst")).distinct()


def importers_of(edges: DataFrame, file) -> DataFrame:
    return edges.where(F.col("dst") == file).select(F.col("src").alias("node")).distinct()


def imports_of(edges: DataFrame, file) -> DataFrame:
    return edges.where(F.col("src") == file).select(F.col("dst").alias("node")).distinct()
