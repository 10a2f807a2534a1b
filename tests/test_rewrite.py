import pytest

from lithoscope.operators import changes, modules
from lithoscope.operators import rewrite as plans
from lithoscope.sources import dataflow, extract, names, rewrite, sample
from lithoscope.sources.extract import Source

HOLDER = "import { q, r } from './q';\n// about f\nexport function f() { return q; }\nr();\n"


def own(operation, text, **args):
    return rewrite.planned(rewrite.File("/p/a.ts", text), operation, **args)


def importer(operation, text, holder, path="/p/c.ts", sources=("./a",), **args):
    return rewrite.planned(rewrite.File(path, text, set(sources), "/p/a.ts", holder), operation, **args)


CASES = [
    ("to_arrow", "export async function f<T>(a: T, b = 2): Promise<T> { return g(a, b); }", {"name": "f"}, "export const f = async <T>(a: T, b = 2): Promise<T> => g(a, b);"),
    ("to_arrow", "function f(a) { g(); return a; }", {"name": "f"}, "const f = (a) => { g(); return a; };"),
    ("to_arrow", "function f() { return { a: 1 }; }", {"name": "f"}, "const f = () => ({ a: 1 });"),
    ("to_async", "export function f(a: number): number { return a; }", {"name": "f"}, "export async function f(a: number): Promise<number> { return a; }"),
    ("modify", "@A()\nexport class X { a = 1 }", {"name": "X", "exported": False, "add_decorators": ["B"], "remove_decorators": ["A"], "is_abstract": True}, "@B\nabstract class X { a = 1 }"),
    ("modify", "function f(a: number, b: string) { }", {"name": "f", "exported": True, "is_async": True, "return_type": "void", "add_params": [("c", "number", "1")], "remove_params": ["a"]},
     "export async function f(b: string, c: number = 1): void { }"),
    ("modify", "let x = 1, y = 2;", {"name": "x", "declaration_kind": "const"}, "const x = 1, y = 2;"),
    ("convert_type", "export type T = { a: string; b?: number; f(): void };", {"name": "T"}, "export interface T {\n  a: string;\n  b?: number;\n}"),
    ("convert_type", "export interface T { a: string; b?: number }", {"name": "T"}, "export type T = { a: string; b?: number };"),
    ("extract_interface", "export class A implements C {\n  x: number = 1;\n  private y = 2;\n  get(a: string): number { return 1; }\n}", {"class_name": "A", "interface_name": "I"},
     "export interface I {\n  x: number;\n  get(a: string): number;\n}\n\nexport class A implements C, I {\n  x: number = 1;\n  private y = 2;\n  get(a: string): number { return 1; }\n}"),
    ("composition", "class B { run(x: number): void {} private p() {} }\nclass A extends B { own() {} }", {"class_name": "A"},
     "class B { run(x: number): void {} private p() {} }\nclass A {\n  private _b = new B();\n own() {} \n  run(x: number): void {\n    return this._b.run(x);\n  }\n}"),
    ("cjs_to_esm", "const fs = require('fs');\nconst { a, b: c } = require(\"./m\");\nexports.x = (p) => p;\nmodule.exports = fs;\n", {},
     "import fs from 'fs';\nimport { a, b as c } from \"./m\";\nexport const x = (p) => p;\nexport default fs;\n"),
    ("replace_with_import", "import { z } from './lib';\nfunction f() { return 1; }\nf();\n", {"name": "f", "source": "./lib"}, "import { z, f } from './lib';\nf();\n"),
    ("inline_variable", "const x = 1 + 2;\nfoo(x, { x }, o.x, x * 3);\nfunction h(x) { return x; }\n", {"name": "x"}, "foo(1 + 2, { x: 1 + 2 }, o.x, (1 + 2) * 3);\nfunction h(x) { return x; }\n"),
    ("inline_function", "function add(a, b) { return a + b; }\nconst y = add(1, z) * 2;\nconst w = add(b, a);\n", {"name": "add"}, "const y = (1 + z) * 2;\nconst w = b + a;\n"),
    ("inline_function", "function id(a) { return a; }\nid(1 + 2);\nid();\n", {"name": "id"}, "1 + 2;\nundefined;\n"),
    ("inline_type", "type Id = string | number;\nfunction f(a: Id[]): Id { return a; }\n", {"name": "Id"}, "function f(a: (string | number)[]): string | number { return a; }\n"),
    ("change_signature", "function f(a: number, b: number) { return b; }\nf(1, f(2, 3));\n", {"name": "f", "add": [("c", "string", "'x'")], "remove": ["a"]},
     "function f(b: number, c: string = 'x') { return b; }\nf(f(3, 'x'), 'x');\n"),
    ("change_signature", "function f() {}\nf();\n", {"name": "f", "add": [("c", "string", None)]}, "function f(c: string) {}\nf(undefined);\n"),
    ("default_to_named", "export default function f() {}\n", {}, "export function f() {}\n"),
    ("default_to_named", "const a = 1;\nexport default a;\n", {}, "const a = 1;\nexport { a };\n"),
    ("class_to_functions", "export class A {\n  x = 1;\n  constructor() {}\n  run(a: number): number { return a; }\n  private p() {}\n}\n", {"class_name": "A"}, "export function run(a: number): number { return a; }\n"),
    ("rename", "export function f(a) { return f(a - 1); }\nconst o = { f, g: f, f: 2 };\nfunction k(f) { return f; }\no.f;\nexport { f as z };\n", {"name": "f", "new": "n"},
     "export function n(a) { return n(a - 1); }\nconst o = { f: n, g: n, f: 2 };\nfunction k(f) { return f; }\no.f;\nexport { n as z };\n"),
    ("safe_delete", "const a = 1, b = 2;\nfoo(b);\n", {"name": "a"}, "const b = 2;\nfoo(b);\n"),
    ("safe_delete", "function a() { return a(); }\nfoo();\n", {"name": "a"}, "foo();\n"),
    ("move", HOLDER, {"name": "f", "to": "/p/lib/b.ts"}, "import { r } from './q';\nr();\n"),
    ("move", "function f() {}\nf();\n", {"name": "f", "to": "/p/lib/b.ts"}, "import { f } from './lib/b';\nf();\n"),
]


@pytest.mark.parametrize("operation,text,args,wanted", CASES)
def test_own_file(operation, text, args, wanted):
    assert own(operation, text, **args) == (wanted, None)


@pytest.mark.parametrize("operation,text,args", [
    ("to_arrow", "function f() { this.x = 1; }", {"name": "f"}), ("to_async", "async function f() {}", {"name": "f"}), ("rename", "const a = 1, b = 2;", {"name": "a", "new": "b"}),
    ("safe_delete", "const a = 1;\na;", {"name": "a"}), ("inline_variable", "let a;", {"name": "a"}), ("inline_function", "function f() { g(); return 1; }", {"name": "f"}),
    ("convert_type", "type A = string;", {"name": "A"}), ("replace_with_import", "export function f() {}", {"name": "f", "source": "./x"}), ("composition", "class A {}", {"class_name": "A"}),
    ("class_to_functions", "class A {} class B extends A {}", {"class_name": "A"}), ("encapsulate", "class A {}", {"class_name": "A", "field_name": "x"}), ("default_to_named", "export default 1;", {}),
    ("to_arrow", "", {"name": "f"}), ("modify", "x", {"name": "f"}),
])
def test_refusals(operation, text, args):
    new, why = own(operation, text, **args)
    assert new is None and why


def test_encapsulate():
    new, _ = own("encapsulate", "class A {\n  name: string = 'a';\n  hi() { return this.name; }\n}\n", class_name="A", field_name="name")
    assert "private _name: string = 'a';" in new and "return this._name; }" in new and "get name(): string {" in new and "set name(value: string) {" in new


def test_extractions():
    text = "function f(a) {\n  const x = g(a + 1) * 2;\n  return g(a + 1);\n}\n"
    at = text.index("g(a + 1)")
    assert own("extract_variable", text, start=at, end=at + 8, name="v")[0] == "function f(a) {\n  const v = g(a + 1);\n  const x = v * 2;\n  return v;\n}\n"
    text = "function f(a) {\n  const b = a;\n  log(a, b);\n  return 1;\n}\n"
    at = text.index("log(")
    assert own("extract_function", text, start=at, end=at + 10, name="g")[0] == "function f(a) {\n  const b = a;\n  g(a, b);\n  return 1;\n}\n\nfunction g(a, b) {\n  log(a, b);\n}\n"
    assert rewrite.name_at(text, 2, 9) == "b"


def test_importers():
    assert importer("move", "import { z } from './z';\n", HOLDER, "/p/lib/b.ts", (), name="f", to="/p/lib/b.ts") == ("import { z } from './z';\n// about f\nexport function f() { return q; }\n", None)
    assert importer("move", "import { f, g } from './a';\nf();\n", HOLDER, name="f", to="/p/lib/b.ts")[0] == "import { g } from './a';\nimport { f } from './lib/b';\nf();\n"
    assert importer("rename", "import { f, g } from './a';\nf(); function w(f) { f(); }\nexport { f as y } from './a';\n", HOLDER, name="f", new="n")[0] == "import { n, g } from './a';\nn(); function w(f) { f(); }\nexport { n as y } from './a';\n"
    assert importer("rename", "import { f as h } from './a';\nh();\n", HOLDER, name="f", new="n")[0] == "import { n as h } from './a';\nh();\n"
    assert importer("inline_function", "import { add } from './a';\nadd(1, 2);\n", "export function add(a, b) { return a + b; }", name="add")[0] == "1 + 2;\n"
    assert importer("inline_variable", "import { x } from './a';\nexport { x } from './a';\n", "export const x = 1;", name="x")[0] is None
    assert importer("change_signature", "import { f as k } from './a';\nk(1, 2);\n", "export function f(a, b) {}", name="f", remove=["a"])[0] == "import { f as k } from './a';\nk(2);\n"
    assert importer("default_to_named", "import g, { z } from './a';\ng();\n", "export default function f() {}")[0] == "import { f as g, z } from './a';\ng();\n"
    assert importer("class_to_functions", "import { A } from './a';\n", "export class A { run() {} }", class_name="A")[0] == "import { run } from './a';\n"
    assert importer("safe_delete", "import { f } from './a';\nf();\n", HOLDER, name="f")[1]
    assert importer("rename", "import { f } from './other';\nf();\n", HOLDER, name="f", new="n") == (None, None)


def test_imports_of_a_file():
    f = lambda t: rewrite.File("/p/a.ts", t)
    run = lambda t, e: rewrite.apply(t, e)
    assert [(d.source, d.default, d.namespace, d.named, d.type_only) for d in rewrite.get_imports("import a, { b as c } from 'x';\nimport * as n from \"y\";\nimport type { T } from './t';\nimport 'z';")] == [
        ("x", "a", None, [("b", "c")], False), ("y", None, "n", [], False), ("./t", None, None, [("T", "T")], True), ("z", None, None, [], False)]
    assert run("x;", rewrite.added_import(f("x;"), "./m", ["a", "b"])) == "import { a, b } from './m';\nx;"
    t = "import { a, b } from './m';\nb;\n"
    assert run(t, rewrite.removed_import(f(t), "./m", ["a"])) == "import { b } from './m';\nb;\n" and run(t, rewrite.removed_import(f(t), "./m")) == "b;\n"
    assert run(t, rewrite.updated_import_path(f(t), "./m", "./n")) == "import { a, b } from './n';\nb;\n" and run(t, rewrite.unused_imports(f(t))) == "import { b } from './m';\nb;\n"


def test_nothing_breaks_the_planner():
    for text in ("", "((((", "class", "export", "import {", "function (", "const x = async", "}{)(", "class A { constructor(", "`${", "type T = <", "import { from"):
        for op, args in (("rename", {"name": "A", "new": "B"}), ("cjs_to_esm", {}), ("safe_delete", {"name": "x"}), ("encapsulate", {"class_name": "A", "field_name": "b"})):
            own(op, text, **args)
        rewrite.unused_imports(rewrite.File("/x", text))
        dataflow.data_flows(text)


def test_scopes_and_contexts():
    s = Source("const a = 1;\nfunction f(b = a) { for (const a of b) { a; } return a; }\nconst g = ({ a: c }) => c + a;\ntry { } catch (a) { a; }\n")
    n = names.Names(s)
    assert [s.line(i) for i in n.references("a")] == [2, 2, 3]
    context = lambda t, name: [n.context(i) for n in [names.Names(Source(t))] for i in range(n.s.n) if n.s.name(i) == name]
    assert context("import { x } from './x'; x = 1; f(x); g(...[x]); return x; x.y; `${x}`; let z: x; export { x };", "x") == [
        "import", "assignment", "call-argument", "usage", "return-value", "property-access", "template-expression", "type-annotation", "export"]
    assert context("const x = 1;", "x") == ["definition"] and context("@x() class A {}", "x") == ["decorator"] and context("f(...x)", "x") == ["spread"]


def test_data_flow():
    d = dataflow.data_flows("import { g } from './g';\nfunction f(a, b = 1) {\n  let x = a + b, y = g(a, h(x));\n  x += y;\n  return x * 2;\n}")[0]
    shown = [(n["name"], n["type"]) for n in d.nodes]
    assert shown == [("a", "parameter"), ("b", "parameter"), ("x", "definition"), ("a", "usage"), ("b", "usage"), ("y", "definition"), ("a", "usage"), ("x", "usage"),
                     ("g", "call"), ("h", "call"), ("x", "assignment"), ("y", "usage"), ("return", "return"), ("x", "usage")]
    assert [(e["src"], e["dst"], e["type"]) for e in d.edges] == [(0, 3, "def-use"), (1, 4, "def-use"), (0, 6, "def-use"), (2, 7, "def-use"), (0, 8, "call-arg"), (2, 9, "call-arg"), (5, 11, "def-use"), (10, 13, "def-use")]
    assert d.nodes[8]["source"] == "./g" and d.nodes[8]["expression"] == "g(a, h(x))"


@pytest.fixture(scope="module")
def project(spark):
    files = spark.createDataFrame(list(sample.FILES.items()), "path string, text string").cache()
    found = extract.extract_all(files).cache()
    return files, found, modules.dependency_edges(found, {"@/": "/p/lib"}).cache()


def test_plans_over_a_project(spark, project):
    files, found, edges = project
    out = {r["path"]: r for r in plans.accepted(plans.plan(files, "rename", "/p/src/make.ts", edges, name="createShape", new="makeShape")).collect()}
    assert set(out) == {"/p/src/make.ts", "/p/src/index.ts"} and "makeShape as createShape" in out["/p/src/index.ts"]["modified"]
    assert "function makeShape(" in out["/p/src/make.ts"]["modified"]
    refused = plans.plan(files, "safe_delete", "/p/src/shapes.ts", edges, name="Square")
    assert {r["path"] for r in refused.collect() if r["error"]} == {"/p/src/make.ts"} and plans.accepted(refused).count() == 0
    assert plans.plan(files, "rename", "/no/such.ts", edges, name="a", new="b").count() == 0
    lost = plans.plan(files, "move", "/p/src/shapes.ts", edges, name="Square", to="/no/such.ts")
    assert plans.accepted(lost).count() == 0 and lost.where("error is not null").count() == 3
    moved = {r["path"]: r["modified"] for r in plans.accepted(plans.plan(files, "move", "/p/src/shapes.ts", edges, name="Square", to="/p/src/store.ts")).collect()}
    assert set(moved) == {"/p/src/shapes.ts", "/p/src/make.ts", "/p/src/store.ts"} and "export class Square implements Shape {" in moved["/p/src/store.ts"]
    assert "import { Square } from './store';" in moved["/p/src/make.ts"] and "class Square" not in moved["/p/src/shapes.ts"]
    back = changes.reversed_set(plans.accepted(plans.plan(files, "to_async", "/p/src/make.ts", name="log")))
    assert back.count() == 0  # an arrow is no function declaration


def test_references_over_a_project(project):
    files, _, edges = project
    got = sorted((r["path"].split("/")[-1], r["context"]) for r in names.find_references(files, edges, "/p/src/shapes.ts", "Square").collect())
    assert got == [("make.ts", "import"), ("make.ts", "usage"), ("shapes.ts", "definition")]
    nodes = dataflow.nodes(dataflow.data_flow(files), edges)
    assert {(r["function_name"], r["source_file"]) for r in nodes.collect() if r["source_file"]} <= {("App", "/p/src/index.ts"), ("useShapes", "/p/src/index.ts")}


def test_copies_and_dead_code(spark):
    files = spark.createDataFrame([
        ("/p/a.ts", "export function pad(s: string): string { return s; }\n"), ("/p/x/b.ts", "function pad(s: string): string { return s + ''; }\npad('1');\n"),
        ("/p/c.ts", "function pad(s: number) { return s; }\n"), ("/p/d.ts", None), ("/p/e.ts", "import { pad } from './a';\n// pad\n"),
    ], "path string, text string")
    got = {r["path"]: (r["modified"], r["error"]) for r in plans.deduplicate(files, "/p/a.ts", "pad").collect()}
    assert got["/p/x/b.ts"] == ("import { pad } from '../a.js';\npad('1');\n", None) and got["/p/c.ts"][1] and len(got) == 2
    found = extract.extract_all(files)
    assert modules.dead_exports(found, modules.dependency_edges(found)).count() == 0
    only = files.where("path <> '/p/e.ts'")
    found = extract.extract_all(only)
    dead = modules.dead_exports(found, modules.dependency_edges(found), "/p/")
    assert [(r["path"], r["modified"]) for r in plans.remove_declarations(only, dead).collect()] == [("/p/a.ts", "")]


def test_an_import_saves_its_own_file_only(spark):
    files = spark.createDataFrame([
        ("/a.ts", "export const x = 1;\nexport default function go() {}\n"), ("/b.ts", "export const x = 2, y = 3;\n"), ("/c.ts", "import go from './a';\nimport { y } from './b';\n"),
        ("/d.ts", "export const z = 1;\n"), ("/e.ts", "export * from './d';\n"),
    ], "path string, text string")
    found = extract.extract_all(files)
    dead = {(r["file_path"], r["name"]) for r in modules.dead_exports(found, modules.dependency_edges(found)).collect()}
    assert dead == {("/a.ts", "x"), ("/b.ts", "x")}
