from pyspark.sql import functions as F

from lithoscope.functions import text
from lithoscope.operators import changes, graph, incremental, lookup, patterns, quality, similarity
from lithoscope.sources import files, schemas


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_dice_over_multisets_and_empty_rules(spark):
    units = spark.createDataFrame([(0, "k", ["a", "b"]), (1, "k", ["a", "b"]), (2, "k", ["x"]), (3, "k", []), (4, "o", ["a", "b"])], "id int, kind string, t array<string>")
    found = {r["unit"]: r["score"] for r in similarity.similar(units, F.col("id") == 0, "id", "kind", F.col("t"), F.col("t"), least=0.0).collect()}
    assert found == {1: 1.0, 2: 0.0, 3: 0.0}
    empty = {r["unit"]: r["score"] for r in similarity.similar(units, F.col("id") == 3, "id", "kind", F.col("t"), F.col("t"), least=0.0).collect()}
    assert empty == {0: 0.0, 1: 0.0, 2: 0.0}
    twice = spark.createDataFrame([(0, "k", []), (1, "k", [])], "id int, kind string, t array<string>")
    assert [r["score"] for r in similarity.similar(twice, F.col("id") == 0, "id", "kind", F.col("t"), F.col("t")).collect()] == [1.0]


def test_reachability_ends_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "b"), ("b", "c", "c"), ("c", "a", "a"), ("d", "a", "a")], schemas.EDGES)
    assert rows(graph.reachable(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.is_reachable(edges, "c", "d") and not graph.is_reachable(edges, "d", "a") and not graph.is_reachable(edges, "a", "a")
    assert rows(graph.reverse(edges).select("dst", F.array_join("sources", ","))) == [("a", "c,d"), ("b", "a"), ("c", "b")]
    assert rows(graph.blast_radius("move", "a", edges)) == [("a",), ("c",), ("d",)]
    assert rows(graph.blast_radius("extract", "a", edges)) == [("a",)]


def test_module_resolution_takes_the_first_hit(spark):
    wanted = spark.createDataFrame([("src", "./m"), ("src", "./n.js"), ("src", "./gone")], "dir string, source string")
    known = spark.createDataFrame([("src/m/index.ts",), ("src/m.ts",), ("src/n.ts",)], "path string")
    found = graph.resolve_first(wanted, graph.module_candidates(F.col("dir"), F.col("source"), [".ts", ".js"]), ["dir", "source"], known)
    assert rows(found.select("source", "resolved")) == [("./gone", None), ("./m", "src/m.ts"), ("./n.js", "src/n.ts")]


def test_edits_apply_from_the_end_and_reverse(spark):
    docs = spark.createDataFrame([("f", "0123456789"), ("g", "same")], "path string, text string")
    edits = spark.createDataFrame([("f", 0, 1, "AA"), ("f", 8, 10, ""), ("f", 4, 4, "-")], "path string, start int, end int, replacement string")
    done = changes.apply_edits(docs, edits)
    assert rows(done) == [("f", "0123456789", "AA123-4567")]
    assert rows(changes.reversed_set(changes.reversed_set(done))) == rows(done)
    diff = done.select(changes.unified_diff("path", "original", "modified")).first()[0]
    assert "-0123456789" in diff and "+AA123-4567" in diff
    log = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "op_id long, path string")
    assert rows(changes.next_undo(log, spark.createDataFrame([(3,)], "op_id long"))) == [(2, "b"), (2, "c")]


def test_incremental_index(spark, tmp_path):
    found = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.0)], "path string, mtime_ms double")
    old = spark.createDataFrame([("a", 1.0, 0), ("b", 1.0, 0), ("gone", 1.0, 0)], "path string, mtime_ms double, made int")
    new = incremental.refreshed(found, old, lambda r: r.withColumn("made", F.lit(1)))
    assert rows(new) == [("a", 1.0, 0), ("b", 2.0, 1), ("c", 9.0, 1)]
    assert incremental.load(spark, str(tmp_path), "path string").count() == 0
    incremental.save(new, str(tmp_path))
    assert rows(incremental.load(spark, str(tmp_path), "path string, mtime_ms double, made int")) == rows(new)


def test_dead_exports_and_copies(spark):
    exports = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "name string, file_path string")
    refs = spark.createDataFrame([("x", "a"), ("y", "b")], "name string, file_path string")
    assert rows(quality.dead_exports(exports, refs)) == [("x", "a"), ("z", "b")]
    assert rows(quality.dead_exports(exports, refs, scope="b")) == [("z", "b")]
    units = spark.createDataFrame([("f", "a", [("p", "T")], "R"), ("f", "b", [("q", "T")], "R"), ("f", "c", [("q", "U")], "R")], f"name string, file_path string, params {schemas.PARAMS}, return_type string")
    found = quality.copies_of(units, units.where("file_path = 'a'"))
    assert rows(found.select("file_path", "compatible")) == [("b", True), ("c", False)]
    assert rows(lookup.search_signature(units, ["T"]).select("file_path")) == [("a",), ("b",)]


def test_names_and_paths(spark):
    df = spark.createDataFrame([("Promise<User>",), ("User[]",), ("User",)], "t string")
    assert [r[0] for r in df.select(text.unwrapped(F.col("t"))).collect()] == ["User"] * 3
    body = spark.createDataFrame([("a  + b\n* ab", ["a", "b"])], "body string, params array<string>")
    assert body.select(text.normalised_body(F.col("body"), F.col("params"))).first()[0] == "__param0__ + __param1__ * ab"
    at = spark.createDataFrame([("C:/x.ts:3:4",), ("x.ts:7",), ("x.ts",)], "t string").select(text.target_location(F.col("t")).alias("l")).select("l.*")
    assert rows(at) == sorted([("C:/x.ts", 3, 4), ("x.ts", 7, None), ("x.ts", None, None)], key=str)


def test_discovery_leaves_out_built_and_hidden_files(spark, tmp_path):
    for p in ("src/a.ts", "src/b.txt", "node_modules/m/i.js", "dist/o.js", ".git/h.js", "dist_x/o.js", "lib/.c.ts", "lib/d.jsx"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    found = files.discover(spark, str(tmp_path))
    assert sorted(r["path"].removeprefix(str(tmp_path)) for r in found.collect()) == ["/lib/d.jsx", "/src/a.ts"]
    kinds = files.project_kind(spark.createDataFrame([("p", '{"name":"n","dependencies":{"react":"1","next":"2"}}'), ("q", "{broken")], "path string, text string"))
    assert rows(kinds) == [("p", "n", "next"), ("q", None, "node")]


def unit(**kw):
    base = dict(file_path="src/a.ts", name="A", kind="class", line=1, exported=True, is_async=False, params=[], return_type="", members=[], extends=None, implements=[],
                decorators=[], constructor_params=[], type_tokens=[], node_types=[], statement_types=[], body_line_count=1, complexity=0)
    return tuple((base | kw).values())


def method(name, static=False, visibility="public", kind="method"):
    return (name, kind, "", False, 0, visibility, static, [])


def test_pattern_rules(spark):
    units = spark.createDataFrame([
        unit(name="One", members=[method("constructor", visibility="private"), method("instance", True, kind="property"), method("getInstance", True)]),
        unit(name="Users", members=[method("find"), method("save"), method("delete")]),
        unit(name="createUsers", kind="function", return_type="Promise<Users>", node_types=["NewExpression"], complexity=2),
        unit(name="Act", members=[method("constructor"), method("execute")]),
        unit(name="S", kind="interface"), unit(name="S1", implements=["S"]), unit(name="S2", implements=["S"]),
        unit(name="useThing", kind="function"),
        unit(name="mw", kind="function", params=[("req", "Request"), ("next", "NextFunction")]),
    ], schemas.CODE_UNITS)
    modules = spark.createDataFrame([("src/index.ts", 0, 0, 2), ("src/f.ts", 6, 2, 0)], "file_path string, n_internal_imports int, n_exports int, n_re_exports int")
    found = {(r["pattern"], r["unit_name"]): round(r["confidence"], 4) for r in patterns.detect(units, modules).collect()}
    assert found == {
        ("singleton", "One"): 0.95, ("repository", "Users"): 0.8, ("factory", "createUsers"): 0.95, ("command", "Act"): 0.75, ("strategy", "S"): 0.8,
        ("react-hooks", "useThing"): 0.95, ("middleware", "mw"): 0.8, ("barrel-module", "src/index.ts"): 0.95, ("facade", "src/f.ts"): 0.8,
    }


def test_rename_of_a_file_rewrites_its_importers(spark):
    docs = spark.createDataFrame([("/p/src/a.ts", "import x from './b';\nimport y from \"./b2\";"), ("/p/c.ts", "import z from './src/b';"), ("/p/src/b.ts", "")], "path string, text string")
    edges = spark.createDataFrame([("/p/src/a.ts", "./b", "/p/src/b.ts"), ("/p/src/a.ts", "./b2", None), ("/p/c.ts", "./src/b", "/p/src/b.ts")], "src string, source string, dst string")
    done = {r["path"]: r["modified"] for r in changes.rename_file_edits(docs, edges, "/p/src/b.ts", "/p/lib/d.ts").collect()}
    assert done == {"/p/src/a.ts": "import x from '../lib/d';\nimport y from \"./b2\";", "/p/c.ts": "import z from './lib/d';"}
