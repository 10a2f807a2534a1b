"""Lookups over units: exact names, conjunctive filters, signatures and members.

Light units are ``name, kind, file_path, exported``; deep units also have ``params array<struct<name,type>>``,
``return_type``, ``members array<struct<name,...>>`` and ``is_async``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def find(units: DataFrame, name: str, column: str = "name") -> DataFrame:
    """Units of exactly this name; the equality reaches the scan."""
    return units.where(F.col(column) == F.lit(name))


def list_units(units: DataFrame, kind: str | None = None, exported: bool | None = None, file_pattern: str | None = None) -> DataFrame:
    """Units that meet every given condition; ``file_pattern`` is a substring of the path."""
    if kind is not None:
        units = units.where(F.col("kind") == kind)
    if exported is not None:
        units = units.where(F.col("exported") == exported)
    if file_pattern is not None:
        units = units.where(F.col("file_path").contains(file_pattern))
    return units


def search_signature(units: DataFrame, param_types: list[str] | None = None, param_count: int | None = None, return_type: str | None = None) -> DataFrame:
    """Units whose whole ordered list of parameter types, their number and return type match what is given."""
    if param_types is not None:
        units = units.where(F.transform("params", lambda p: p["type"]) == F.array(*[F.lit(t) for t in param_types]).cast("array<string>"))
    if param_count is not None:
        units = units.where(F.size("params") == param_count)
    if return_type is not None:
        units = units.where(F.col("return_type") == return_type)
    return units


def search_pattern(light: DataFrame, deep: DataFrame, kind=None, has_member=None, is_async=None, name_pattern=None) -> DataFrame:
    """Light units by name and kind, then, only if a deep condition is given, by a semi join with deep units."""
    found = list_units(light, kind=kind)
    if name_pattern is not None:
        found = found.where(F.col("name").contains(name_pattern))
    if has_member is None and is_async is None:
        return found
    if has_member is not None:
        deep = deep.where(F.exists("members", lambda m: m["name"] == has_member))
    if is_async is not None:
        deep = deep.where(F.col("is_async") == is_async)
    return found.join(deep.select("file_path", "name"), ["file_path", "name"], "left_semi")
