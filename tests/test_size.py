"""What keeps queries over source code in proportion to their input: many tasks, each text read once in a batch, few passes."""

import re
from pathlib import Path
from posixpath import join, normpath

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from conftest import SMALL
from lithoscope.operators import graph, modules, patterns, trees
from lithoscope.plans import project, registry
from lithoscope.plans.registry import QUERIES
from lithoscope.sources import extract, sample
from lithoscope.sources.batches import rows_by_text
from lithoscope.sources.files import EXTENSIONS
from lithoscope.sources.schemas import CODE_UNITS


def passes(frame) -> int:
    """How often a plan reads source texts."""
    return len(re.findall("MapIn(?:Arrow|Pandas)", frame._jdf.queryExecution().optimizedPlan().toString()))


def test_copies_are_read_in_many_tasks(spark):
    found = extract.extract_all(project.project_files(spark, SMALL), ["is_module"])
    tasks = found.where("path <> '/p/lib/util.js'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 16 and max(t["count"] for t in tasks) <= 200 * 5 / 8


def test_an_id_that_is_there_twice_has_one_copy(spark):
    ids = spark.createDataFrame([(3,), (3,), (4,)], "id long")
    assert sample.project(ids).where("path like '/p/3/%'").count() == 5


def test_equal_texts_are_read_once_in_a_batch(spark):
    files = [(f"/{i}", ["a b", "c", None, ""][i % 4]) for i in range(4000)]
    read = spark.sparkContext.accumulator(0)

    def words(text):
        read.add(1)
        return [{"word": w, "n": len(w)} for w in text.split()]

    found = rows_by_text(spark.createDataFrame(files, "path string, text string").coalesce(1), "file", "word string, n int", words).collect()
    assert sorted(map(tuple, found)) == sorted((p, w, len(w)) for p, t in files for w in (t or "").split())
    assert read.value <= 3 * 4


def test_records_are_those_of_each_file(spark):
    texts = [*sample.FILES.values(), "", None, "export const a = [1, 2", "\0", "import x from './é';\nexport { x as ü }"]
    files = [(f"/{i}.ts", t) for i, t in enumerate(texts * 30)]
    found = extract.extract_all(spark.createDataFrame(files, "path string, text string").repartition(3)).collect()
    expected = {p: extract.extract_text(p, t or "") for p, t in files}
    assert len(found) == len(files)
    for r in found:
        assert {k: v for k, v in r.asDict(True).items()} == expected[r["path"]]


@pytest.mark.parametrize("name, most", [("code_resolved_imports", 1), ("code_dependencies", 2), ("code_references", 2)])
def test_imports_are_resolved_in_one_pass(spark, name, most):
    assert passes(QUERIES[name](spark, SMALL)) <= most


def test_imports_meet_every_candidate_in_order(spark):
    files = ["/s/a.ts", "/s/a.js", "/s/b.js", "/s/b.js.ts", "/s/c/index.tsx", "/s/c.js/index.ts", "/s/d.cjs", "/s/e", "/s/e.js", "/s/f.d.ts", "/s/g.mjs", "/s/index.ts", "/u/h.jsx", "/s/i.ts/index.js", "/s/j.jsx.js"]
    sources = ["./a", "./a.js", "./a.ts", "./b", "./b.js", "./c", "./c.js", "./c/index", "./c/index.js", "./d", "./d.cjs", "./d.js", "./e", "./e.js", "./f", "./f.d", "./f.d.js", "./g", "./g.mjs", ".", "./", "..", "@/h", "@/h.js", "h",
               "../s/a", "./i.ts", "./i", "./j", "./j.jsx", "./none", "./a"]
    text = "".join(f"import x{i} from '{s}';\n" for i, s in enumerate(sources))
    rows = spark.createDataFrame([(f, text if f == "/s/a.ts" else "") for f in files], "path string, text string")
    edges = modules.dependency_edges(extract.extract_all(rows), {"@/": "/u"}).collect()
    assert sorted(e["source"] for e in edges) == sorted(sources)
    for e in edges:
        if not e["source"].startswith((".", "@/")):
            assert e["dst"] is None
            continue
        base = normpath(join("/u", e["source"][2:]) if e["source"].startswith("@/") else join("/s", e["source"]))
        [wanted] = spark.createDataFrame([(base,)], "base string").select(graph.module_candidates(F.lit(base.rsplit("/", 1)[0]), F.lit(base.rsplit("/", 1)[1]), EXTENSIONS)).first()
        assert e["dst"] == next((c for c in wanted if c in files), None), e


@pytest.mark.parametrize("name, most", [("code_patterns", 5), ("code_structural_patterns", 4), ("code_pattern_evidence", 6)])
def test_patterns_are_found_in_few_passes(spark, name, most):
    assert 0 < passes(QUERIES[name](spark, SMALL)) <= most


def test_rules_on_units_with_nulls(spark):
    params, none = [("a", "Api")], None
    unit = lambda name, kind, **own: tuple(({"file_path": "/a.ts", "name": name, "kind": kind, "line": 1} | own).get(c) for c in StructType.fromDDL(CODE_UNITS).names)
    made = {"node_types": ["NewExpression"], "return_type": "Promise<Disc>", "complexity": 1}
    units = spark.createDataFrame([
        unit("Shape", "interface"), unit("Once", "interface"), unit(none, "interface"), unit("Disc", "class", implements=["Shape", none], constructor_params=params),
        unit("Square", "class", implements=["Shape"]), unit("Other", "class", implements=["Once", none]), unit(none, "class"), unit("makeDisc", "function", **made),
        unit("makeNone", "function", **made | {"return_type": "None"}), unit("makeAny", "function", **made | {"return_type": none}), unit("useDisc", "arrow", **made)], CODE_UNITS)
    files = spark.createDataFrame([("/a.ts", 0, 0, 0)], "file_path string, n_internal_imports int, n_exports int, n_re_exports int")
    found = patterns.detect(units, files)
    assert sorted((r["pattern"], r["unit_name"], r["confidence"]) for r in found.collect()) == [
        ("adapter", "Disc", 0.65), ("dependency-injection", "Disc", 0.4), ("factory", "makeDisc", 0.7 + 0.1), ("react-hooks", "useDisc", 0.95), ("strategy", "Shape", 0.8)]
    said = {r["pattern"]: (r["evidence"], r["related_units"]) for r in patterns.with_evidence(found, units).collect()}
    assert said["strategy"] == (["implementations 2"], ["Disc", "Square"]) and said["factory"] == (["makes Disc"], ["Disc"])
    assert said["adapter"] == (["takes Api", "implements Shape"], [])


def test_a_walk_sorts_once_in_tasks_by_size(spark, monkeypatch):
    assert QUERIES["tree_walk"](spark, SMALL).rdd.getNumPartitions() == 4
    monkeypatch.setattr(registry, "TASK_MB", 0.01)
    walk = QUERIES["tree_walk"](spark, SMALL)
    size = sum(f.stat().st_size for f in [Path(SMALL, "lineitem.parquet")])
    assert size / (0.01 * 2**20) <= walk.rdd.getNumPartitions() <= size / (0.01 * 2**20) + 1
    plan = walk._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("Join", plan)) == 1 and "Aggregate" not in plan


def test_a_walk_of_trees_and_of_no_tree(spark):
    rows = [(1, 0, None, 0), (1, 1, 0, 0), (1, 2, 0, 1), (2, 0, None, 0), (None, 0, None, 0), (None, 1, 0, 0), (3, 1, 0, 0)]
    found = trees.children_first(spark.createDataFrame(rows, "tree int, id int, parent int, place int")).collect()
    assert sorted((r["tree"], r["id"], r["visit"], r["post_visit"]) for r in found) == [(1, 0, 0, 2), (1, 1, 1, 0), (1, 2, 2, 1), (2, 0, 0, 0), (3, 1, 1, 0)]
