from lithoscope.operators import modules
from lithoscope.sources import extract, flow, sample
from lithoscope.sources.lexer import lex


def kinds(text):
    return [(x.kind, x.text) for x in lex(text)[0]]


def test_lexer_places_regexes_templates_and_comments():
    assert kinds("a / b /* c */ // d\n") == [("id", "a"), ("punct", "/"), ("id", "b")]
    assert kinds("return /[/]x/g") == [("id", "return"), ("regex", "/[/]x/g")]
    assert ("template", "`a${b + `${c}`}`") in kinds("x = `a${b + `${c}`}`") and ("id", "c") in kinds("`${`${c}`}`")
    assert kinds("'it\\'s' \"a") == [("str", "'it\\'s'"), ("punct", '"'), ("id", "a")]
    assert kinds("") == [] and len(kinds("`open ${")) >= 1


def test_records_of_the_sample():
    made = extract.extract_text("/p/src/make.ts", sample.FILES["/p/src/make.ts"])
    shape, scale, log = made["units"]
    assert (shape["name"], shape["kind"], shape["line"], shape["exported"], shape["return_type"]) == ("createShape", "function", 4, True, "Promise<Shape[]>")
    assert shape["params"] == [{"name": "kind", "type": "string"}, {"name": "size", "type": "number"}]
    assert shape["complexity"] == 5 and shape["statement_types"] == ["conditional", "variable-def", "loop", "return"] and "NewExpression" in shape["node_types"]
    assert (scale["kind"], scale["is_async"], log["exported"], log["return_type"]) == ("arrow", True, False, "void")
    assert [(c["caller_name"], c["target_name"]) for c in made["calls"]] == [
        ("createShape", "Promise.resolve"), ("createShape", "scale"), ("createShape", "test"), ("createShape", "log"), ("createShape", "Promise.resolve"), ("log", "console.log")]
    store = extract.extract_text("s", sample.FILES["/p/src/store.ts"])["units"][0]
    assert store["extends"] == "EventEmitter" and store["decorators"] == [{"name": "Injectable", "args": ["{ scope: 'app' }"]}]
    assert store["constructor_params"] == [{"name": "api", "type": "ApiClient"}]
    assert [(m["name"], m["kind"]) for m in store["members"]][:4] == [("instance", "property"), ("constructor", "method"), ("constructor", "constructor"), ("getInstance", "method")]
    util = extract.extract_text("u", sample.FILES["/p/lib/util.js"])
    assert util["imports"] == [{"source": "fs", "specifiers": ["default"], "is_external": True}] and [e["name"] for e in util["exports"]] == ["read", "write"]
    app = extract.extract_text("a", sample.FILES["/p/src/app.tsx"])
    assert app["units"][0]["statement_types"] == ["variable-def", "return"] and "JSXElement" in app["units"][0]["node_types"]


def test_nothing_breaks_the_extractor():
    for text in ("", "((((", "class", "export", "import {", "function (", "const x = async", "}{)(", "class A { constructor(", "export default", "@", "`${", "type T = <", "a ? b : c => d"):
        assert extract.extract_text("x", text)["path"] == "x"


def test_graphs_of_the_sample(spark):
    found = extract.extract_all(spark.createDataFrame(list(sample.FILES.items()), "path string, text string"))
    edges = modules.dependency_edges(found, {"@/": "/p/lib"})
    inner = {(r["src"], r["dst"]) for r in edges.collect() if r["dst"]}
    s = "/p/src"
    assert inner == {(f"{s}/make.ts", f"{s}/shapes.ts"), (f"{s}/index.ts", f"{s}/shapes.ts"), (f"{s}/index.ts", f"{s}/make.ts"), (f"{s}/index.ts", f"{s}/store.ts"),
                     (f"{s}/app.tsx", f"{s}/index.ts"), (f"{s}/app.tsx", "/p/lib/util.js")}
    nodes = {r["path"]: (r["is_entry"], r["is_leaf"]) for r in modules.modules(found, edges).collect()}
    assert [p for p, x in nodes.items() if x[0]] == [f"{s}/app.tsx"] and {p for p, x in nodes.items() if x[1]} == {f"{s}/shapes.ts", f"{s}/store.ts", "/p/lib/util.js"}
    calls = {(r["src"].split("/")[-1], r["dst"].split("/")[-1]) for r in modules.call_edges(found).collect()}
    assert calls == {("app.tsx:App", "make.ts:createShape"), ("app.tsx:useShapes", "make.ts:createShape"), ("make.ts:createShape", "make.ts:log"), ("make.ts:createShape", "make.ts:scale")}
    light = {(r["name"], r["kind"]): r["exported"] for r in extract.light_units(found).collect()}
    assert light[("log", "variable")] is False and light[("Square", "class")] is True


def graph(text):
    f = flow.flows(text)[0]
    return [(b["id"], b["type"], b["successors"]) for b in f.blocks], f


def test_control_flow():
    assert graph("function f() { a(); b(); }")[0] == [(0, "entry", [2]), (1, "exit", []), (2, "body", [1])]
    got, f = graph("function f(x) { if (x) { return 1; } else g(x); h() }")
    assert got == [(0, "entry", [2]), (1, "exit", []), (2, "body", [3]), (3, "branch", [4, 5]), (4, "body", [1]), (5, "body", [6]), (6, "body", [1])]
    assert f.blocks[5]["calls"] == ["g"] and f.blocks[6]["calls"] == ["h"]
    got, _ = graph("function f(xs: T[]): number { for (const x of xs) { if (x) continue; } return 0; dead(); }")
    assert [b[1] for b in got] == ["entry", "exit", "body", "loop", "body", "branch", "body", "body", "body"] and got[-1][2] == [1]
    got, _ = graph("function f() { try { a(); } catch (e) { b(); } finally { c(); } }")
    kinds = {b[1]: b for b in got}
    assert kinds["try"][2] == [kinds["catch"][0], kinds["finally"][0]] and kinds["catch"][2] == [kinds["finally"][0]]
    got, _ = graph("function f(x) { switch (x) { case 1: return 1; case 2: a(); break; default: b(); } c(); }")
    assert [len(b[2]) for b in got if b[1] == "switch"] == [3] and [b[2] for b in got if b[1] == "case"][0] == [1]
    assert [b[2] for b in graph("function f(x) { switch (x) { } c(); }")[0] if b[1] == "switch"] == [[]]
    for text in ("function f() {", "function f() { if (", "function f() { do", "function f() { try {", "function f() { switch (x) { case", "function f("):
        flow.flows(text)


def test_control_flow_rows(spark):
    found = flow.control_flow(spark.createDataFrame(list(sample.FILES.items()), "path string, text string"))
    assert {r["function_name"] for r in found.collect()} == {"createShape", "App", "useShapes", "unused"}
