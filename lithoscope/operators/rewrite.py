"""Plans of source rewrites over ``files(path, text)``: rows ``path, original, modified, error``, to be applied as a change set.

Only files that hold the symbol, import it or receive it reach Python; the holder's text, bounded by one file, goes along as
a scalar subquery. Each file is planned apart from the others. A null text counts as empty; rows that stay as they are drop out.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.sources import rewrite as rw
from lithoscope.sources.extract import Source
from lithoscope.sources.names import declaration

PLAN = "path string, original string, modified string, error string"


def _mapped(rows: DataFrame, one) -> DataFrame:
    """``one(row) -> (new text or None, error or None)`` for every row with ``path`` and ``text``."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                row["text"] = row["text"] or ""
                new, error = one(row)
                if new is not None or error is not None:
                    out.append((row["path"], row["text"], new, error))
            if out:
                yield pd.DataFrame(out, columns=["path", "original", "modified", "error"])

    return rows.mapInPandas(run, PLAN)


def _holder(files: DataFrame, path: str):
    return files.where(F.col("path") == path).agg(F.min("text")).scalar()


def plan(files: DataFrame, operation: str, path: str, edges: DataFrame | None = None, **args) -> DataFrame:
    """The rewrite ``operation`` (see ``sources.rewrite.REWRITES``) of file ``path`` and of its direct importers.

    ``edges(src, source, dst)`` are resolved imports; without them only the file itself is planned. No such file: no rows.
    """
    wanted = files.where(F.col("path") == path).select("path", F.array().cast("array<string>").alias("sources"))
    if edges is not None and rw.REWRITES[operation].importer:
        wanted = wanted.unionByName(edges.where((F.col("dst") == path) & (F.col("src") != path)).select(F.col("src").alias("path"), F.array("source").alias("sources")))
    if "to" in args and args["to"] != path:
        wanted = wanted.unionByName(files.where(F.col("path") == args["to"]).select("path", F.array().cast("array<string>").alias("sources")))
    each = wanted.groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"))
    rows = files.select("path", "text").join(each, "path").withColumn("holder_text", F.coalesce(_holder(files, path), F.lit("")))

    there = files.where(F.col("path") == args.get("to", path)).agg(F.count("*") > 0).scalar()
    rows = rows.withColumn("there", there)

    def one(row):
        if not row["there"]:
            return None, f"no file '{args['to']}' to move to"
        return rw.planned(rw.File(row["path"], row["text"], set(row["sources"]), path, row["holder_text"]), operation, **args)

    return _mapped(rows, one)


def accepted(planned: DataFrame) -> DataFrame:
    """The change set of a plan, empty if any of its files refuses."""
    refused = planned.where(F.col("error").isNotNull()).select(F.lit(1).alias("one")).limit(1)
    whole = planned.where(F.col("modified").isNotNull()).withColumn("one", F.lit(1))
    return whole.join(refused, "one", "left_anti").select("path", "original", "modified")


def deduplicate(files: DataFrame, canonical: str, name: str, scope: str | None = None) -> DataFrame:
    """Other files' own declarations of ``name`` replaced by an import from ``canonical``.

    ``scope`` is a part of the path. A function whose parameter types or return type differ is left, with the reason as its error.
    """
    rows = files.where((F.col("path") != canonical) & F.col("text").contains(name))
    if scope is not None:
        rows = rows.where(F.col("path").contains(scope))
    rows = rows.select("path", "text").withColumn("holder_text", _holder(files, canonical)).where(F.col("holder_text").isNotNull())

    def signature(s: Source, d) -> tuple | None:
        if d.kind != "function":
            return None
        h = rw.Head.of(s, d.name_at)
        return tuple(p["type"] for p in s.params(h.p)), h.returns

    def one(row):
        try:
            holder, f = Source(row["holder_text"]), rw.File(row["path"], row["text"])
            theirs, own = declaration(holder, name), declaration(f.s, name)
            if not theirs or not own:
                return None, None
            a, b = signature(holder, theirs), signature(f.s, own)
            if a and b and a != b:
                return None, f"incompatible signature of '{name}'"
            edits = [rw.removal(f, own), *rw.added_import(f, rw.specifier(row["path"], canonical, ".js"), [name])]
            return rw.apply(row["text"], edits), None
        except (IndexError, KeyError, RecursionError) as e:
            return None, f"{type(e).__name__}: {e}"

    return _mapped(rows, one)


def remove_declarations(files: DataFrame, dead: DataFrame) -> DataFrame:
    """Declarations ``dead(file_path, name)`` taken out of their files."""
    names = dead.groupBy(F.col("file_path").alias("path")).agg(F.collect_set("name").alias("names"))

    def one(row):
        f = rw.File(row["path"], row["text"])
        new = rw.apply(row["text"], rw.dead_declarations(f, list(row["names"])))
        return (new if new != row["text"] else None), None

    return _mapped(files.select("path", "text").join(names, "path"), one)


def add_import(files: DataFrame, source: str, names: list[str]) -> DataFrame:
    """Named imports added to every file, merged into an import of the same source."""
    return _import_change(files, lambda f: rw.added_import(f, source, names))


def remove_import(files: DataFrame, source: str, names: list[str] | None = None) -> DataFrame:
    """Named imports (or, without names, every import) of ``source`` taken out."""
    return _import_change(files, lambda f: rw.removed_import(f, source, names))


def update_import_path(files: DataFrame, old: str, new: str) -> DataFrame:
    return _import_change(files, lambda f: rw.updated_import_path(f, old, new))


def remove_unused_imports(files: DataFrame) -> DataFrame:
    return _import_change(files, rw.unused_imports)


def _import_change(files: DataFrame, edits) -> DataFrame:
    def one(row):
        new = rw.apply(row["text"], edits(rw.File(row["path"], row["text"])))
        return (new if new != row["text"] else None), None

    return _mapped(files.select("path", "text"), one)
