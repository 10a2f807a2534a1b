"""Duplicates, copies of a canonical unit, dead exports, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_groups(units: DataFrame, body: Column, unit: str) -> DataFrame:
    """``body_md5, n, first_id`` of bodies that more than one unit has; a digest, so no text is shuffled."""
    return units.where(body.isNotNull()).groupBy(F.md5(body.cast("binary")).alias("body_md5")).agg(
        F.count("*").alias("n"), F.min(unit).alias("first_id")
    ).where(F.col("n") > 1)


def duplicate_members(units: DataFrame, body: Column) -> DataFrame:
    """``units`` that belong to a group, with ``body_md5``."""
    marked = units.where(body.isNotNull()).withColumn("body_md5", F.md5(body.cast("binary")))
    many = marked.groupBy("body_md5").count().where(F.col("count") > 1).select("body_md5")
    return marked.join(many, "body_md5", "left_semi")


def copies_of(units: DataFrame, canonical: DataFrame) -> DataFrame:
    """``units`` of the name of a ``canonical`` unit in another file, with ``compatible``: equal parameter types and
    return type, or neither has a signature."""
    c = canonical.select("name", F.col("file_path").alias("canonical_file"), F.transform("params", lambda p: p["type"]).alias("c_types"), F.col("return_type").alias("c_return"))
    own = F.transform("params", lambda p: p["type"])
    same = own.eqNullSafe(F.col("c_types")) & F.col("return_type").eqNullSafe(F.col("c_return"))
    return units.join(c, "name").where(F.col("file_path") != F.col("canonical_file")).withColumn("compatible", same).drop("c_types", "c_return")


def dead_exports(exports: DataFrame, references: DataFrame, scope: str | None = None) -> DataFrame:
    """Rows of ``exports(name, file_path)`` that no other file refers to (``references(name, file_path)``)."""
    if scope is not None:
        exports = exports.where(F.col("file_path").startswith(scope))
    r = references.select(F.col("name").alias("r_name"), F.col("file_path").alias("r_file")).distinct()
    return exports.join(r, (F.col("name") == F.col("r_name")) & (F.col("file_path") != F.col("r_file")), "left_anti")
