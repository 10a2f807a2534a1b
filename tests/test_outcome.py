"""Outcomes of planned changes, writing and undoing them; manifests; hashes of subtrees; long walks."""

import pytest
from pyspark.sql import functions as F

from lithoscope.operators import callgraph, changes, graph, outcome, trees, views
from lithoscope.sources import extract, project, sample

PLANS = "op_id long, path string, original string, modified string, error string"


def test_outcomes(spark):
    plans = spark.createDataFrame([(1, "a", "x", "y", None), (1, "b", "x", "x", None), (2, "a", "x", "y", None), (2, "b", "x", None, "no"), (3, "a", "x", "x", None)], PLANS)
    statuses = lambda **k: {r["op_id"]: (r["status"], r["n_files"]) for r in outcome.outcome(plans, **k).collect()}
    assert statuses() == {1: ("apply", 1), 2: ("failed", 0), 3: ("unchanged", 0)}
    assert statuses(json=True)[1] == ("json", 1) and statuses(dry_run=True)[1] == ("preview", 1)
    assert [(r["op_id"], r["path"]) for r in outcome.applicable(plans).collect()] == [(1, "a")]
    assert outcome.outcome(plans.limit(0)).count() == 0


def test_changes_are_written_and_undone(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("old " + name)
    one = spark.createDataFrame([("/a", "old a", "new a"), ("/b", "old b", "new b\r\né")], "path string, original string, modified string")
    two = spark.createDataFrame([("/a", "new a", "newer a")], one.schema)
    log = f"file://{tmp_path}/log"
    for i, step in enumerate((one, two)):
        outcome.apply_changes(step, str(tmp_path))
        outcome.append_undo(log, step, i, f"step {i}")
    assert (tmp_path / "a").read_text() == "newer a" and (tmp_path / "b").read_bytes() == "new b\r\né".encode()
    assert outcome.undo(spark, log, str(tmp_path)) == 1 and (tmp_path / "a").read_text() == "new a"
    assert outcome.undo(spark, log, str(tmp_path)) == 0 and (tmp_path / "b").read_text() == "old b"
    assert outcome.undo(spark, log, str(tmp_path)) is None
    assert not [p for p in tmp_path.iterdir() if p.suffix == ".new"]


def test_projects(spark):
    rows = [
        ("/r/package.json", '{"name": "r", "workspaces": {"packages": ["packages/*"]}, "devDependencies": {"react": "1", "vue": "3", "typescript": "5"}}'),
        ("/r/packages/a/package.json", '{"name": "@r/a", "dependencies": {"x": "1", "y": "2"}}'), ("/r/packages/b/package.json", "{}"), ("/r/packages/c/package.json", "no JSON"),
        ("/x/manifest.json", '{"manifest_version": 3}'), ("/t/tsconfig.json", '{"compilerOptions": {"paths": {"@/*": ["./src/*"], "lib": ["lib/index"]}}}'), ("/n/package.json", None)]
    manifests = spark.createDataFrame(rows, "path string, text string")
    found = {r["root"]: r for r in project.projects(manifests).collect()}
    assert found["/r"]["types"] == ["monorepo", "react", "vue"] and found["/r"]["framework"] == "vue" and found["/r"]["has_typescript"]
    assert found["/x"]["types"] == ["chrome-extension"] and found["/n"]["types"] == ["node"] and not found["/n"]["has_typescript"]
    assert project.alias_folders(found["/t"]) == {"@/": "/t/src", "lib": "/t/lib/index"}
    packages = {r["path"]: (r["name"], r["dependencies"]) for r in project.workspace_packages(manifests).collect()}
    assert packages == {"/r/packages/a": ("@r/a", ["x", "y"]), "/r/packages/b": ("b", [])}
    assert project.merged_settings({"exclude": ["a"]}) == {"tsconfig": "tsconfig.json", "exclude": ["a"]}


def test_subtree_hashes(spark):
    schema = "tree long, id long, parent long, place int, type string"
    rows = [(1, 0, None, 0, "+"), (1, 1, 0, 0, "a"), (1, 2, 0, 1, "-"), (1, 3, 2, 0, "b"), (1, 4, 2, 1, "c")]
    swapped = [(2, 0, None, 0, "+"), (2, 1, 0, 1, "a"), (2, 2, 0, 0, "-"), (2, 3, 2, 0, "b"), (2, 4, 2, 1, "c")]
    other = [(3, *r[1:3], 1 - r[3] if r[2] == 2 else r[3], r[4]) for r in rows]
    hashes = {(r["tree"], r["id"]): r["hash"] for r in trees.subtree_hashes(spark.createDataFrame(rows + swapped + other, schema), ["+"]).collect()}
    assert len(hashes) == 15 and hashes[1, 0] == hashes[2, 0] != hashes[3, 0] and hashes[1, 2] == hashes[2, 2] != hashes[3, 2]
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, 0, "x") for i in range(4)], schema)
    with pytest.raises(ValueError):
        trees.subtree_hashes(deep, most_levels=2)


def test_long_walk(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(5, 2)], "src long, dst long")
    found = {r["node"]: r["steps"] for r in graph.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect()}
    assert found == {i: i for i in range(21)}
    assert graph.reachable(edges, spark.createDataFrame([(0,)], "node long"), 3).count() == 4


def test_call_stats_and_views(spark):
    found = extract.extract_all(spark.createDataFrame([*sample.FILES.items(), ("/p/src/x.test.ts", "function t() { scale(1); }")], "path string, text string"))
    row = callgraph.call_stats(found).first()
    assert (row["functions"], row["exported"], row["test_files"], row["source_files"]) == (7, 4, 1, 6)
    assert [r["file_path"] for r in callgraph.of_function(callgraph.nodes(found), "scale").collect()] == ["/p/src/make.ts"]
    assert {r["by_name"] for r in callgraph.called_by(found).where("name = 'scale'").collect()} == {"createShape", "t"}
    units = extract.units(found)
    assert views.discover_search(units, kind="class", has_member="area").count() == 2
    assert views.discover_search(units, param_count=0, kind="class").where("kind = 'class'").count() == units.where("kind = 'class' and size(params) = 0").count()
    rows = spark.createDataFrame([(i, i % 2) for i in range(8)], "v long, g long")
    assert sorted((r["v"], r["place"]) for r in views.top(rows, "g", [F.desc("v")], 2).collect()) == [(4, 2), (5, 2), (6, 1), (7, 1)]
    assert [r["v"] for r in views.top(rows, None, ["v"], 3).orderBy("place").collect()] == [0, 1, 2]
    assert changes.change_set(rows.select(F.lit("p").alias("path"), F.lit("a").alias("original"), F.lit("a").alias("modified"))).count() == 0
