"""Queries over source code: a copy of the library's small project for each document, so the project grows with the scale.

The SQL holds the rows that the project's sources call for (``golden``), once for each document where a row is a copy's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.operators import callgraph, changes, modules, patterns, rewrite, symbols, views
from lithoscope.sources import dataflow, extract, flow, names, sample

QUERIES: dict = {}
GOLDEN_FOR: list[str] = []
ALIASES = {"@/": "/p/lib"}
MAKE, SHAPES, STORE, APP, UTIL = "/p/0/src/make.ts", "/p/0/src/shapes.ts", "/p/0/src/store.ts", "/p/0/src/app.tsx", "/p/lib/util.js"


def query(golden: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if golden:
            GOLDEN_FOR.append(f.__name__)
        return f

    return add


def project_files(spark, sf_dir) -> DataFrame:
    return sample.project(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id")))


def project(spark, sf_dir, *columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, records (with the arrays named, or all) and resolved imports."""
    files = project_files(spark, sf_dir)
    return files, extract.extract_all(files, list(columns) or None), modules.dependency_edges(extract.extract_all(files, ["imports"]), ALIASES, files)


def _listed(column: str):
    return F.array_join(F.col(column), ",").alias(column)


@query()
def code_units(spark, sf_dir):
    return extract.units(project(spark, sf_dir, "units")[1]).select("file_path", "name", "kind", "line", "exported", "is_async", "return_type", "complexity", "body_line_count")


@query()
def code_imports(spark, sf_dir):
    return extract.imports(project(spark, sf_dir, "imports")[1]).select("path", "source", _listed("specifiers"), "is_external")


@query()
def code_exports(spark, sf_dir):
    return extract.exports(project(spark, sf_dir, "exports")[1])


@query()
def code_light_units(spark, sf_dir):
    return extract.light_units(project(spark, sf_dir, "exports", "top_level")[1])


@query()
def code_members(spark, sf_dir):
    """Members of classes and interfaces."""
    return extract.units(project(spark, sf_dir, "units")[1]).select("file_path", "name", F.explode("members").alias("m")).select(
        "file_path", "name", F.col("m.name").alias("member"), "m.kind", "m.type", "m.is_async", "m.param_count", "m.visibility", "m.is_static")


@query()
def code_resolved_imports(spark, sf_dir):
    return project(spark, sf_dir)[2].select("src", "source", _listed("specifiers"), "dst")


@query()
def code_dependencies(spark, sf_dir):
    files, _, edges = project(spark, sf_dir)
    return modules.modules(files, edges).where("path <> '/p/lib/util.js'")


@query()
def code_call_graph(spark, sf_dir):
    return modules.call_edges(project(spark, sf_dir, "units", "calls")[1])


@query()
def code_call_nodes(spark, sf_dir):
    """Functions of the call graph with what they call."""
    return callgraph.nodes(project(spark, sf_dir, "units", "calls")[1]).select("file_path", "name", "line", "exported", "is_test", _listed("calls"))


@query()
def code_called_by(spark, sf_dir):
    """Callers of each function; a name that many files define means the first of them."""
    return callgraph.called_by(project(spark, sf_dir, "units", "calls")[1]).select("by_file", "by_name", "file_path", "name")


def _detected(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Patterns, and the units that they are found in."""
    files, found, edges = project(spark, sf_dir, "units")
    units = extract.units(found)
    counts = modules.file_counts(extract.extract_all(files, ["exports"]), edges)
    return patterns.detect(units, counts, files.select(F.col("path").alias("file_path"))), units


@query()
def code_patterns(spark, sf_dir):
    return _detected(spark, sf_dir)[0].select("file_path", "pattern", "category", "unit_name", "line", "confidence")


@query()
def code_pattern_evidence(spark, sf_dir):
    """Patterns with the units that they rest on and what speaks for them."""
    return patterns.with_evidence(*_detected(spark, sf_dir)).where("category <> 'framework'").select(
        "file_path", "pattern", "unit_name", F.array_join("evidence", "; ").alias("evidence"), F.array_join("related_units", ",").alias("related_units"))


@query()
def code_strategy(spark, sf_dir):
    return patterns.strategy(extract.units(project(spark, sf_dir, "units")[1])).select("file_path", "unit_name", "line", "confidence")


@query()
def code_structural_patterns(spark, sf_dir):
    """The patterns of one category."""
    return views.of_category(_detected(spark, sf_dir)[0], "structural").select("file_path", "pattern", "unit_name", "confidence")


@query()
def code_file_exports(spark, sf_dir):
    """One file's exports, with the path below the root."""
    _, found, _ = project(spark, sf_dir, "exports")
    return views.below(views.of_file(extract.exports(found), "/p/0/src/index.ts"), "/p").select("path", "name", "source")


@query()
def code_file_graph(spark, sf_dir):
    """One file's imports and importers."""
    _, found, edges = project(spark, sf_dir)
    return views.file_graph(edges, "/p/0/src/make.ts")


@query()
def code_re_exports(spark, sf_dir):
    """Names exported again, by the module that they come from."""
    return modules.re_exports(project(spark, sf_dir, "exports")[1]).select("path", "source", _listed("names"))


@query()
def code_search(spark, sf_dir):
    """Units found by signature, which wins over the other conditions if both are given."""
    units = extract.units(project(spark, sf_dir, "units")[1])
    return views.discover_search(units, params=["string", "number"], kind="class").select("file_path", "name", "kind", "line")


@query()
def code_symbols(spark, sf_dir):
    """Definitions and references of a name by file."""
    index = symbols.index(project(spark, sf_dir, "imports", "top_level")[1])
    return symbols.definitions_of(index, "createShape").select("file_path", F.lit("definition").alias("role")).unionByName(
        symbols.references_of(index, "createShape").select("file_path", F.lit("reference").alias("role")))


@query()
def code_requires(spark, sf_dir):
    """Modules that CommonJS files require at top level."""
    return extract.shallow_requires(project_files(spark, sf_dir))


@query()
def cfg_blocks(spark, sf_dir):
    """Control-flow blocks of the project's functions."""
    ids = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return flow.control_flow(project_files(spark, sf_dir)).select("file_path", "function_name", "id", "type", "label", F.array_join("statements", " | ").alias("statements"), ids("successors"), ids("predecessors"), "start_line", "end_line")


@query()
def dfg_nodes(spark, sf_dir):
    files, _, edges = project(spark, sf_dir)
    return dataflow.nodes(dataflow.data_flow(files), edges)


@query()
def dfg_edges(spark, sf_dir):
    return dataflow.flow_edges(dataflow.data_flow(project_files(spark, sf_dir)))


@query()
def code_references(spark, sf_dir):
    """References to one exported function, with their contexts."""
    files, _, edges = project(spark, sf_dir)
    return names.find_references(files, edges, MAKE, "createShape")


@query()
def code_contexts(spark, sf_dir):
    """How often a symbol is referred to in each context."""
    files, _, edges = project(spark, sf_dir)
    return views.contexts(names.find_references(files, edges, SHAPES, "Square"))


@query()
def code_dead_exports(spark, sf_dir):
    _, found, edges = project(spark, sf_dir, "exports")
    return modules.dead_exports(found, edges).select("file_path", "name")


def _plan(operation: str, path: str, **args):
    """A query that plans one rewrite: the lines that go and come in each file."""

    def run(spark, sf_dir):
        files, _, edges = project(spark, sf_dir)
        planned = rewrite.accepted(rewrite.plan(files, operation, path, edges, **args))
        lines = F.split(changes.unified_diff("path", "original", "modified"), "\n")
        of = lambda sign: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3)), lambda x: F.substring(x, 2, 1000)), " | ")
        return planned.select("path", of("-").alias("removed"), of("+").alias("added"))

    run.__name__ = f"code_{operation}"
    return query()(run)


_plan("rename", MAKE, name="createShape", new="makeShape")
_plan("move", SHAPES, name="Square", to=STORE)
_plan("extract_interface", SHAPES, class_name="Disc", interface_name="Round")
_plan("inline_variable", MAKE, name="log")
_plan("change_signature", MAKE, name="createShape", add=[("color", "string", "'red'")], remove=["size"])
_plan("to_arrow", APP, name="useShapes")
_plan("to_async", APP, name="useShapes")
_plan("convert_type", SHAPES, name="Shape")
_plan("modify", MAKE, name="createShape", is_async=True, add_params=[("color", "string", None)])
_plan("encapsulate", SHAPES, class_name="Square", field_name="name")
_plan("composition", STORE, class_name="ShapeStore")
_plan("class_to_functions", STORE, class_name="ShapeStore")
_plan("cjs_to_esm", UTIL)
_plan("default_to_named", APP)
_plan("safe_delete", UTIL, name="unused")


def oracle_sql() -> dict[str, str]:
    """The golden rows as SQL: a row with ``/p/#/`` once for each document."""
    from lithoscope.plans import golden

    kinds = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "boolean": "BOOLEAN", "double": "DOUBLE"}

    def literal(x):
        return "NULL" if x is None else str(x) if isinstance(x, (bool, int, float)) else "'" + x.replace("'", "''") + "'"

    out = {}
    for name, rows in golden.ROWS.items():
        columns, types = golden.COLUMNS[name], [kinds[t] for t in golden.TYPES[name]]
        values = ",\n  ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
        cast = [f"CAST({c} AS {t}) AS {c}" for c, t in zip(columns, types)]
        copied = [f"replace(CAST({c} AS VARCHAR), '/p/#/', '/p/' || doc_id || '/') AS {c}" if t == "VARCHAR" else x for c, t, x in zip(columns, types, cast)]
        first = columns[0]
        out[name] = (
            f"WITH v({', '.join(columns)}) AS (VALUES\n  {values})\n"
            f"SELECT {', '.join(cast)} FROM v WHERE {first} NOT LIKE '%#%'\n"
            f"UNION ALL SELECT {', '.join(copied)} FROM (SELECT * FROM v WHERE {first} LIKE '%#%'), (SELECT DISTINCT doc_id FROM documents)"
        )
        # ``@2N`` is twice the number of copies.
        out[name] = out[name].replace("implementations @2N'", "implementations ' || (SELECT CAST(2 * count(DISTINCT doc_id) AS VARCHAR) FROM documents)")
    return out
