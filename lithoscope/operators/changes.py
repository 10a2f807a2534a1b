"""Planned edits: grouped application, change sets, their reversal, diffs and an append-only undo log."""

from __future__ import annotations

import difflib
import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """``path, original, modified`` of ``files(path, text)`` under ``edits(path, start, end, replacement)``.

    Edits of a file (bounded by the file) apply from the last place to the first, so that none moves another.
    """
    own = edits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement")), asc=False).alias("edits"))
    text = lambda t, a, n: F.substring(t, a, n)
    edited = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(
        text(t, F.lit(1), e["start"].cast("int")), e["replacement"], text(t, e["end"].cast("int") + 1, F.greatest(F.lit(0), F.length(t) - e["end"].cast("int")))
    ))
    return files.join(own, "path").select("path", F.col("text").alias("original"), edited.alias("modified"))


def change_set(rows: DataFrame) -> DataFrame:
    """Only what changes."""
    return rows.where(~F.col("original").eqNullSafe(F.col("modified")))


def reversed_set(changes: DataFrame) -> DataFrame:
    return changes.withColumns({"original": F.col("modified"), "modified": F.col("original")})


@F.pandas_udf(StringType())
def unified_diff(path: pd.Series, original: pd.Series, modified: pd.Series) -> pd.Series:
    """A unified diff of each row."""
    return pd.Series(["".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{p}", f"b/{p}")) for p, a, b in zip(path, original, modified)], path.index, dtype=object)


def to_json(changes: DataFrame) -> DataFrame:
    return changes.select(F.to_json(F.struct("path", "original", "modified")).alias("json"))


def next_undo(log: DataFrame, undone: DataFrame) -> DataFrame:
    """Rows of the latest operation in ``log(op_id, ...)`` that is not in ``undone(op_id)``."""
    open_ones = log.join(undone.select("op_id").distinct(), "op_id", "left_anti")
    last = open_ones.agg(F.max("op_id").alias("op_id"))
    return open_ones.join(F.broadcast(last), "op_id", "left_semi")


def rename_file_edits(files: DataFrame, edges: DataFrame, old: str, new: str) -> DataFrame:
    """``path, original, modified`` of the importers of ``old`` once their quoted specifiers lead to ``new``.

    ``edges(src, source, dst)`` are resolved imports. Only exact quoted specifiers change; the file itself is not moved.
    """
    wanted = edges.where(F.col("dst") == old).select(F.col("src").alias("path"), "source").distinct()
    each = wanted.withColumn("target", relative_specifier(F.col("path"), F.lit(new)))
    pairs = each.groupBy("path").agg(F.collect_list(F.struct("source", "target")).alias("pairs"))
    modified = F.aggregate("pairs", F.col("text"), lambda t, p: F.replace(
        F.replace(t, F.concat(F.lit("'"), p["source"], F.lit("'")), F.concat(F.lit("'"), p["target"], F.lit("'"))),
        F.concat(F.lit('"'), p["source"], F.lit('"')), F.concat(F.lit('"'), p["target"], F.lit('"')),
    ))
    return change_set(files.join(pairs, "path").select("path", F.col("text").alias("original"), modified.alias("modified")))


@F.pandas_udf(StringType())
def relative_specifier(importer: pd.Series, target: pd.Series) -> pd.Series:
    """The specifier of ``target`` in ``importer``: relative, without extension, with a leading dot."""

    def one(a: str, b: str) -> str:
        path = posixpath.relpath(posixpath.splitext(b)[0], posixpath.dirname(a))
        return path if path.startswith(".") else f"./{path}"

    return pd.Series([one(a, b) for a, b in zip(importer, target)], importer.index, dtype=object)
