"""Dependency and call graphs over extracted records."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.operators import graph
from lithoscope.sources import extract
from lithoscope.sources.files import EXTENSIONS

EXTENSION = "(" + "|".join(map(re.escape, EXTENSIONS)) + r")\z"


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[cm]?jsx?$", "")


def _by_stem(paths: DataFrame) -> DataFrame:
    """``key, paths``: what may be meant by an import whose path has the stem ``key``, at most a few files for each."""
    path = F.col("path")
    bare, folder = (F.when(path.rlike(x), F.regexp_replace(path, x, "")) for x in (EXTENSION, f"/index{EXTENSION}"))
    keys = F.array_compact(F.array(_stem(path), bare, _stem(bare), _stem(folder)))
    return paths.select("path", F.explode(F.array_distinct(keys)).alias("key")).groupBy("key").agg(F.collect_set("path").alias("paths"))


def dependency_edges(extracted: DataFrame, aliases: dict[str, str] | None = None, files: DataFrame | None = None) -> DataFrame:
    """``src, source, specifiers, dst``: imports with the file that they resolve to, null for what is external.

    ``aliases`` maps prefixes of specifiers to folders. A relative import that resolves to no file counts as external too.
    ``files(path)`` are the same files as ``extracted``'s, if they can be listed without reading them again. An import meets the
    few files of its stem, and the first of its candidates among them counts.
    """
    used = extract.imports(extracted).select(F.col("path").alias("src"), "source", "specifiers")
    folder = F.regexp_extract("src", r"^(.*/)?", 0)
    spelled, root = F.col("source"), folder
    for prefix, target in (aliases or {}).items():
        hit = F.col("source").startswith(prefix)
        spelled = F.when(hit, F.concat(F.lit("./"), F.substr("source", F.lit(len(prefix) + 1)))).otherwise(spelled)
        root = F.when(hit, F.lit(target)).otherwise(root)
    placed = used.withColumn("base", F.when(spelled.startswith("."), extract.joined_path(root, spelled)))
    # what has no base gets keys of its own, of which no file has one and which don't meet in one task
    placed = placed.withColumn("key", F.coalesce(_stem(F.col("base")), F.concat(F.lit("\0"), "src")))
    stem = _stem(F.col("base"))
    every = [F.col("base"), *[F.concat("base", F.lit(e)) for e in EXTENSIONS], *[F.concat(stem, F.lit(e)) for e in EXTENSIONS], *[F.concat("base", F.lit(f"/index{e}")) for e in EXTENSIONS]]
    first = F.get(F.filter(F.array(*every), lambda c: F.array_contains("paths", c)), F.lit(0))
    return placed.join(_by_stem((extracted if files is None else files).select("path")), "key", "left").select("src", "source", "specifiers", first.alias("dst"))


def modules(extracted: DataFrame, edges: DataFrame) -> DataFrame:
    """``path, n_imports, n_imported_by, is_entry, is_leaf`` of each file."""
    inner = edges.where(F.col("dst").isNotNull())
    outgoing = inner.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_imports"))
    incoming = inner.groupBy(F.col("dst").alias("path")).agg(F.count_distinct("src").alias("n_imported_by"))
    both = extracted.select("path").join(outgoing, "path", "left").join(incoming, "path", "left").na.fill(0)
    return both.withColumns({"is_entry": F.col("n_imported_by") == 0, "is_leaf": F.col("n_imports") == 0})


def call_edges(extracted: DataFrame) -> DataFrame:
    """``src, dst`` (``file:name``): calls from within a named function to the first definition of their target.

    First means by path and line, over all files. Calls of nothing that is defined, and from top level, drop out.
    """
    defined = extract.units(extracted).where(F.col("kind").isin("function", "arrow")).select("file_path", "name", "line")
    first = graph.first_definitions(defined, "name", ["file_path", "line"]).select(F.col("name").alias("target_name"), F.concat_ws(":", "file_path", "name").alias("dst"))
    called = extract.calls(extracted).join(defined.select("file_path", F.col("name").alias("caller_name")).distinct(), ["file_path", "caller_name"], "left_semi")
    return called.join(first, "target_name").select(F.concat_ws(":", "file_path", "caller_name").alias("src"), "dst", "pos")


def file_counts(extracted: DataFrame, edges: DataFrame) -> DataFrame:
    """What the file rules of patterns see."""
    inner = edges.where(F.col("dst").isNotNull()).groupBy(F.col("src").alias("path")).agg(F.count_distinct("dst").cast("int").alias("n_internal_imports"))
    again = F.size(F.filter("exports", lambda e: e["is_re_export"]))
    return extracted.select("path", F.size("exports").alias("n_exports"), again.alias("n_re_exports")).join(inner, "path", "left").na.fill(0).withColumnRenamed("path", "file_path")


def exported_names(extracted: DataFrame) -> DataFrame:
    """``name, file_path, by_default`` of what files export of their own.

    ``by_default`` marks the name recorded right after a default export: it may be what the default import means.
    """
    each = extracted.select(F.col("path").alias("file_path"), F.posexplode("exports").alias("at", "e"), F.array_position(F.transform("exports", lambda x: x["name"]), "default").alias("default_at"))
    own = each.where(~F.col("e.is_re_export") & (F.col("e.name") != "default")).select("e.name", "file_path", ((F.col("default_at") > 0) & (F.col("at") == F.col("default_at"))).alias("by_default"))
    return own.groupBy("name", "file_path").agg(F.max("by_default").alias("by_default"))


def dead_exports(extracted: DataFrame, edges: DataFrame, scope: str | None = None) -> DataFrame:
    """``name, file_path`` of exports that no other file imports or exports again; an import of all of a file (``*``) saves all.

    Uses within the file itself save nothing. ``scope`` is the beginning of the path.
    """
    exported = exported_names(extracted)
    if scope is not None:
        exported = exported.where(F.col("file_path").startswith(scope))
    used = edges.where(F.col("dst").isNotNull() & (F.col("dst") != F.col("src"))).select(F.col("dst").alias("file_path"), F.explode("specifiers").alias("used")).distinct()
    whole = used.where("used = '*'").select("file_path")
    named = exported.join(whole, "file_path", "left_anti")
    direct = named.join(used.withColumnRenamed("used", "name"), ["file_path", "name"], "left_anti")
    by_default = used.where("used = 'default'").select("file_path", F.lit(True).alias("by_default"))
    return direct.join(by_default, ["file_path", "by_default"], "left_anti").select("name", "file_path")


def re_exports(extracted: DataFrame) -> DataFrame:
    """``path, source, names``: what a file exports again, by the module that it comes from."""
    again = extracted.select("path", F.posexplode("exports").alias("at", "e")).where("e.is_re_export")
    return again.groupBy("path", F.col("e.source").alias("source")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "e.name"))), lambda n: n["name"]).alias("names"))
