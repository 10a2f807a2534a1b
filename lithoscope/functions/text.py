"""Scalar column functions over names, types and paths. All stay in Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Return types that say nothing about a class, generic wrappers, and patterns of test files.
EXCLUDED_TYPES = [
    "void", "string", "number", "boolean", "undefined", "null",
    "any", "unknown", "never", "object", "symbol", "bigint",
]
WRAPPERS = [
    "Promise", "Array", "Set", "Map", "WeakMap", "WeakSet",
    "Record", "Partial", "Required", "Readonly", "Omit", "Pick",
    "Extract", "Exclude", "ReturnType", "InstanceType", "Parameters",
    "Awaited", "IterableIterator", "AsyncIterableIterator", "Generator",
]
TEST_FILES = [r"\.test\.[jt]sx?$", r"\.spec\.[jt]sx?$", r"/__tests__/", r"/e2e/", r"/test/", r"\.stories\.[jt]sx?$"]


def normalised_space(text: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalised_body(body: Column, params: Column) -> Column:
    """``body`` with the i-th of ``params`` (names) as ``__param{i}__``, white space collapsed."""
    numbered = F.transform(params, lambda p, i: F.struct(p.alias("name"), i.alias("i")))
    renamed = F.aggregate(
        numbered, body,
        lambda text, p: F.regexp_replace(text, F.concat(F.lit(r"\b\Q"), p["name"], F.lit(r"\E\b")), F.concat(F.lit("__param"), p["i"].cast("string"), F.lit("__"))),
    )
    return normalised_space(renamed)


def unwrapped(type_text: Column, wrappers: list[str] = WRAPPERS) -> Column:
    """One level of ``Wrapper<X>`` or ``X[]`` off a type."""
    generic = F.regexp_extract(type_text, rf"^(?:{'|'.join(wrappers)})<(.+)>$", 1)
    listed = F.regexp_extract(type_text, r"^(.+)\[\]$", 1)
    return F.when(generic != "", generic).when(listed != "", listed).otherwise(type_text)


def is_hook(name: Column) -> Column:
    """A name of ``use`` and a capital letter."""
    return name.rlike(r"^use[A-Z]")


def half_up(x: Column) -> Column:
    """Rounded to a whole number, halves towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("long")


def target_location(target: Column) -> Column:
    """``file[:line[:column]]`` as a struct of path, line and column; a drive letter belongs to the path."""
    pattern = r"^((?:[A-Za-z]:)?[^:]+)(?::(\d+))?(?::(\d+))?$"
    part = lambda i: F.regexp_extract(target, pattern, i)
    return F.struct(part(1).alias("path"), F.nullif(part(2), F.lit("")).cast("int").alias("line"), F.nullif(part(3), F.lit("")).cast("int").alias("column"))


def external(source: Column) -> Column:
    """Whether an import source is external by its spelling: it doesn't start with a dot."""
    return ~source.startswith(".")


def layer_of(path: Column) -> Column:
    """The layer of a relative path: its second part under ``src`` (if deeper than two), else its first."""
    parts = F.split(path, "/")
    return F.when((parts[0] == "src") & (F.size(parts) > 2), parts[1]).otherwise(parts[0])


def is_test_file(path: Column) -> Column:
    return path.rlike("|".join(TEST_FILES))


def is_excluded_type(type_text: Column) -> Column:
    """No type, or one that names no class of a project."""
    bare = F.lower(F.trim(type_text))
    return type_text.isNull() | (bare == "") | bare.isin(EXCLUDED_TYPES)
