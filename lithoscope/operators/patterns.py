"""Design-pattern rules over code units: each is a test and a confidence, and all are one table.

Units follow ``code_units`` (see ``lithoscope.sources.schemas``). A rule's result has ``pattern, category, file_path,
unit_name, line, confidence``. All rules over units are expressions of one row, so one scan serves them; what factory and
strategy need to know of other units is one small table, which meets that scan once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import is_excluded_type, is_test_file, unwrapped

# Names that the rules look for.
OBSERVER_METHODS = ["on", "off", "emit", "addEventListener", "removeEventListener", "subscribe", "unsubscribe", "notify", "addListener", "removeListener"]
COMMAND_METHODS = ["execute", "run", "handle", "invoke", "perform"]
CRUD_METHODS = ["find", "findOne", "findAll", "findById", "get", "getAll", "getById", "create", "save", "insert", "add", "update", "patch", "delete", "remove", "destroy"]
INJECTION_DECORATORS = ["Injectable", "Service", "Inject"]
UNTYPED = ["string", "number", "boolean", "unknown", "any"]
FACTORY_NAME = r"^(create|make|build|from|of)[A-Z]"
OUT = ["pattern", "category", "file_path", "unit_name", "line", "confidence"]


def _count(array: Column, test) -> Column:
    return F.size(F.filter(F.coalesce(array, F.array()), test))


def _d(x: float) -> Column:
    return F.lit(float(x))


def _when(test: Column, x: float) -> Column:
    return F.when(test, _d(x)).otherwise(_d(0))


def _found(units: DataFrame, rules: list[tuple]) -> DataFrame:
    """Rows of all ``rules(pattern, category, test, confidence, need)`` in one scan; ``need`` is null where nothing else has to hold."""
    each = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(pattern).alias("pattern"), F.lit(category).alias("category"), confidence.alias("confidence"), need.cast("string").alias("need")))
        for pattern, category, test, confidence, need in rules
    ]))
    return units.select("file_path", F.col("name").alias("unit_name"), "line", F.explode(each).alias("f")).select(
        "f.pattern", "f.category", "file_path", "unit_name", "line", "f.confidence", "f.need")


def _unit_rules(units: DataFrame) -> list[tuple]:
    """Rules that see one unit at a time."""
    members, params = F.coalesce(F.col("members"), F.array().cast(units.schema["members"].dataType)), F.col("params")
    is_class = F.col("kind") == "class"
    method = lambda m: m["kind"] == "method"
    named = lambda names: (lambda m: method(m) & m["name"].isin(names))
    static = lambda names: F.exists(members, lambda m: m["is_static"] & m["name"].isin(names))
    private_ctor = F.exists(members, lambda m: (m["name"] == "constructor") & (m["visibility"] == "private"))
    get_instance = F.exists(members, lambda m: method(m) & m["is_static"] & m["name"].isin("getInstance", "instance"))
    singleton = _d(0.4) + _when(static(["instance", "_instance"]), 0.3) + _when(get_instance, 0.25)
    setters = _count(members, lambda m: method(m) & m["name"].rlike(r"^(set|with|add)"))
    n_observers = _count(members, named(OBSERVER_METHODS))
    observer = _when(F.coalesce(F.col("extends").isin("EventEmitter", "EventTarget"), F.lit(False)), 0.5) + F.when(n_observers >= 2, _d(0.2) * F.least(n_observers, F.lit(3))).otherwise(_d(0))
    own_methods = F.filter(members, lambda m: method(m) & (m["name"] != "constructor"))
    last = F.element_at(params, -1)
    names = F.transform(params, lambda p: p["name"])
    is_in = lambda i, *xs: F.coalesce(F.get(names, F.lit(i)).isin(*xs), F.lit(False))
    typed_next = (F.size(params) >= 2) & F.coalesce(last["type"].rlike("(?i)next"), F.lit(False))
    middleware = (
        F.when(typed_next, _d(0.7) + _when(F.exists(params, lambda p: p["type"].rlike("(?i)request|req")), 0.1))
        .when(is_in(0, "req", "request") & is_in(1, "res", "response") & is_in(2, "next"), _d(0.75))
        .when(is_in(0, "ctx", "context") & is_in(1, "next"), _d(0.7))
    )
    self_property = F.exists(members, lambda m: (m["kind"] == "property") & m["type"].contains(F.col("name")))
    grows = F.exists(members, lambda m: method(m) & m["name"].rlike(r"^(add|remove)"))
    crud = _count(members, named(CRUD_METHODS))
    injected = _count(F.col("constructor_params"), lambda p: ~p["type"].isin(UNTYPED))
    decorated = F.exists(F.coalesce(F.col("decorators"), F.array().cast(units.schema["decorators"].dataType)), lambda d: d["name"].isin(INJECTION_DECORATORS))
    injection = _when(decorated, 0.5) + F.when(injected > 0, _d(0.3) + F.least(_d(0.1) * injected, _d(0.2))).otherwise(_d(0))
    has = lambda names: F.exists(members, named(names))
    rules = [
        ("singleton", "creational", is_class & private_ctor, singleton),
        ("builder", "creational", is_class & has(["build", "create", "make"]) & (setters >= 2), _d(0.8)),
        ("observer", "behavioral", is_class & (observer >= 0.4), observer),
        ("middleware", "behavioral", F.col("kind").isin("function", "arrow") & middleware.isNotNull(), middleware),
        ("command", "behavioral", is_class & (F.size(own_methods) == 1) & F.coalesce(F.get(own_methods, F.lit(0))["name"].isin(COMMAND_METHODS), F.lit(False)), _d(0.75)),
        ("composite", "structural", is_class & self_property, F.when(grows, _d(0.85)).otherwise(_d(0.6))),
        ("dependency-injection", "architectural", is_class & (F.size("constructor_params") > 0) & (injection >= 0.3), injection),
        ("repository", "architectural", is_class & (crud >= 3), F.least(_d(0.5) + _d(0.1) * crud, _d(0.95))),
    ]
    return [(*r, F.lit(None)) for r in rules]


def unit_rules(units: DataFrame) -> DataFrame:
    """Rules that see one unit at a time."""
    return _found(units, _unit_rules(units)).drop("need")


def _factory() -> tuple:
    fit = (
        F.col("kind").isin("function", "arrow") & ~is_test_file(F.col("file_path")) & ~F.col("name").rlike(r"^use[A-Z]")
        & ~is_excluded_type(F.col("return_type")) & F.array_contains("node_types", "NewExpression")
    )
    confidence = _d(0.7) + _when(F.col("complexity") >= 2, 0.15) + _when(F.col("name").rlike(FACTORY_NAME), 0.1)
    return "factory", "creational", fit, confidence, F.concat(F.lit("class "), unwrapped(F.col("return_type")))


def factory(units: DataFrame) -> DataFrame:
    """Functions that make an instance of one of the project's classes."""
    return _known(_found(units, [_factory()]), units.where(F.col("kind") == "class").select(F.concat(F.lit("class "), "name").alias("need")).distinct())


def _strategy() -> tuple:
    return "strategy", "behavioral", (F.col("kind") == "interface") & F.col("name").isNotNull(), _d(0.8), F.concat(F.lit("interface "), "name")


def strategy(units: DataFrame) -> DataFrame:
    """Interfaces that at least two classes implement."""
    many = units.where(F.col("kind") == "class").select(F.explode("implements").alias("i")).groupBy(F.concat(F.lit("interface "), "i").alias("need")).count().where("count >= 2")
    return _known(_found(units, [_strategy()]), many.select("need"))


def _known(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` without rows whose ``need`` isn't in ``known(need)``, which has each once. Rows that need nothing are spread by
    a key of their own."""
    key = F.coalesce("need", F.concat(F.lit("\0"), "file_path"))
    met = found.withColumn("key", key).join(known.select(F.col("need").alias("key"), F.lit(True).alias("met")), "key", "left")
    return met.where("need is null or met").select(*OUT)


def _adapter() -> tuple:
    other = F.array_except(F.transform("constructor_params", lambda p: p["type"]), F.coalesce(F.col("implements"), F.array().cast("array<string>")))
    wraps = F.size(F.filter(other, lambda t: t != "unknown")) > 0
    return "adapter", "structural", (F.col("kind") == "class") & (F.size("implements") > 0) & wraps, _d(0.65), F.lit(None)


def adapter(units: DataFrame) -> DataFrame:
    """Classes that implement something and wrap another known type."""
    return _found(units, [_adapter()]).drop("need")


def all_unit_rules(units: DataFrame) -> DataFrame:
    """The rules over units, factory, strategy and adapter: one scan for what fits, one for the classes that those refer to."""
    is_class = units.where(F.col("kind") == "class")
    names = F.concat(F.array(F.concat(F.lit("class "), "name")), F.transform(F.coalesce("implements", F.array().cast("array<string>")), lambda i: F.concat(F.lit("interface "), i)))
    known = is_class.select(F.explode(names).alias("need")).groupBy("need").count().where(F.col("need").startswith("class ") | (F.col("count") >= 2))
    return _known(_found(units, [*_unit_rules(units), _factory(), _strategy(), _adapter()]), known.select("need"))


def file_rules(files: DataFrame) -> DataFrame:
    """Facades and barrels of ``files(file_path, n_internal_imports, n_exports, n_re_exports)``."""
    n, e, r = F.col("n_internal_imports"), F.col("n_exports"), F.col("n_re_exports")
    files = files.withColumns({"name": F.col("file_path"), "line": F.lit(1)})
    facade = (n >= 4) & (e > 0) & (e <= n / 3) & (r <= F.lit(0.7) * e) & ~F.col("file_path").contains("/cli/commands/")
    barrel = F.col("file_path").rlike(r"index\.(ts|js)$") & (r >= 2)
    return _found(files, [
        ("facade", "structural", facade, F.least(_d(0.5) + _d(0.05) * n, _d(0.9)), F.lit(None)),
        ("barrel-module", "architectural", barrel, _d(0.95), F.lit(None)),
    ]).drop("need")


def framework(units: DataFrame) -> DataFrame:
    """One row for each framework pattern that occurs outside test files."""
    units = units.where(~is_test_file(F.col("file_path")))
    fn = F.col("kind").isin("function", "arrow")
    decorated = lambda name: F.exists(F.coalesce(F.col("decorators"), F.array().cast(units.schema["decorators"].dataType)), lambda d: d["name"] == name)
    found = F.array_compact(F.array(
        F.when(fn & F.col("name").startswith("use") & (F.length("name") > 3), F.struct(F.lit("react-hooks").alias("p"), F.lit(0.95).alias("c"))),
        F.when(F.exists("node_types", lambda t: t.startswith("JSX")), F.struct(F.lit("react-components").alias("p"), F.lit(0.9).alias("c"))),
        F.when(fn & F.col("name").startswith("with") & (F.length("name") > 4) & (F.size("params") >= 1), F.struct(F.lit("react-hoc").alias("p"), F.lit(0.7).alias("c"))),
        *[F.when(decorated(d), F.struct(F.lit(p).alias("p"), F.lit(0.95).alias("c"))) for d, p in (("Injectable", "angular-services"), ("Component", "angular-components"), ("NgModule", "angular-modules"))],
    ))
    return units.select("file_path", "name", "line", F.explode(found).alias("f")).groupBy(F.col("f.p").alias("pattern")).agg(
        F.lit("framework").alias("category"), F.min("file_path").alias("file_path"), F.min_by("name", F.struct("file_path", "line")).alias("unit_name"),
        F.min_by("line", F.struct("file_path", "line")).alias("line"), F.max("f.c").alias("confidence"),
    )


# Words in a lower-cased path that name a layer.
LAYER_WORDS = {
    "controllers": "controller|route",
    "models": "model|entity|schema",
    "views": "view|template|component",
    "services": "service|provider",
}


def layered(files: DataFrame) -> DataFrame:
    """One row if files of at least two layers occur; ``mvc`` if controllers and models are among them."""
    low = F.lower("file_path")
    found = files.agg(*[F.count_if(low.rlike(words)).alias(layer) for layer, words in LAYER_WORDS.items()], F.min("file_path").alias("file_path"))
    n = sum((F.when(F.col(layer) > 0, 1).otherwise(0) for layer in LAYER_WORDS), F.lit(0))
    name = F.when((F.col("controllers") > 0) & (F.col("models") > 0), "mvc").otherwise("layered-architecture")
    return found.where(n >= 2).select(
        name.alias("pattern"), F.lit("architectural").alias("category"), "file_path", F.lit(None).cast("string").alias("unit_name"), F.lit(1).alias("line"),
        F.when(n >= 3, _d(0.85)).otherwise(_d(0.6)).alias("confidence"),
    )


def detect(units: DataFrame, files: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """All rules, the surest first. ``paths(file_path)`` are those of ``files``, if they can be listed without reading them."""
    parts = [all_unit_rules(units), file_rules(files), layered(files if paths is None else paths), framework(units)]
    out = parts[0].select(*OUT)
    for p in parts[1:]:
        out = out.unionByName(p.select(*OUT))
    return out.orderBy(F.desc("confidence"), "pattern", "file_path", "unit_name")


def coverage(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files with a pattern, all files, and the rounded percentage."""
    hit = patterns.select("file_path").distinct().join(files.select("file_path").distinct(), "file_path", "left_semi").withColumn("hit", F.lit(1))
    both = files.select("file_path").distinct().join(hit, "file_path", "left").agg(F.count("hit").alias("covered"), F.count("*").alias("files"))
    return both.withColumn("percent", F.when(F.col("files") > 0, F.floor(F.lit(100.0) * F.col("covered") / F.col("files") + F.lit(0.5))).otherwise(0).cast("long"))


def by_category_counts(patterns: DataFrame) -> DataFrame:
    """``category, n`` of the categories that occur."""
    return patterns.groupBy("category").agg(F.count("*").alias("n"))


def with_evidence(patterns: DataFrame, units: DataFrame) -> DataFrame:
    """``patterns`` with ``locations``, ``evidence`` (what speaks for it, in words) and ``related_units``: of a strategy the classes that
    implement it, of a factory the class that it makes, else none."""
    named = lambda names: F.array_join(F.transform(F.filter("members", lambda m: (m["kind"] == "method") & m["name"].isin(names)), lambda m: m["name"]), ", ")
    # short texts rather than members and parameters meet the patterns
    unit = units.select(
        "file_path", F.col("name").alias("unit_name"), "line", "extends", F.exists("members", lambda m: m["is_static"] & m["name"].isin("instance", "_instance")).alias("instance"),
        named(OBSERVER_METHODS).alias("observes"), named(CRUD_METHODS).alias("stores"), F.array_join(F.transform("constructor_params", lambda p: p["type"]), ", ").alias("takes"),
        F.array_join("implements", ", ").alias("implements"), unwrapped(F.col("return_type")).alias("makes"))
    classes = units.where(F.col("kind") == "class").select(F.explode("implements").alias("key"), "name")
    implementers = classes.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("by"))
    key = F.when(F.col("pattern") == "strategy", F.col("unit_name")).otherwise(F.concat(F.lit("\0"), "file_path"))
    both = patterns.join(unit, ["file_path", "unit_name", "line"], "left").withColumn("key", key).join(implementers, "key", "left")
    says = F.array_compact(F.array(
        F.when(F.col("pattern") == "singleton", F.lit("private constructor")),
        F.when((F.col("pattern") == "singleton") & F.col("instance"), F.lit("static instance")),
        F.when((F.col("pattern") == "observer") & F.col("extends").isNotNull(), F.concat(F.lit("extends "), F.col("extends"))),
        F.when(F.col("pattern") == "observer", F.concat(F.lit("methods "), "observes")),
        F.when(F.col("pattern") == "repository", F.concat(F.lit("methods "), "stores")),
        F.when(F.col("pattern").isin("dependency-injection", "adapter"), F.concat(F.lit("takes "), "takes")),
        F.when(F.col("pattern") == "adapter", F.concat(F.lit("implements "), "implements")),
        F.when(F.col("pattern") == "strategy", F.concat(F.lit("implementations "), F.col("n").cast("string"))),
        F.when(F.col("pattern") == "factory", F.concat(F.lit("makes "), "makes")),
    ))
    related = F.when(F.col("pattern") == "strategy", F.col("by")).when(F.col("pattern") == "factory", F.array("makes")).otherwise(F.array().cast("array<string>"))
    return both.select(*OUT, F.array(F.struct("file_path", "unit_name", "line")).alias("locations"), says.alias("evidence"), related.alias("related_units"))
