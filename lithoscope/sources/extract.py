"""Typed records of source files from their tokens: imports, exports, code units, calls, and file summaries.

There is no syntax tree here. Declarations, parameters, members, decorators and calls are read from tokens and brackets;
``node_types`` is a sequence of node names derived from tokens in order, so it is comparable within this library only.
A file that can't be read as a whole gives what could be read. Spark sees one generator: ``extract_all`` turns
``files(path, text)`` into rows with arrays, which ``imports``, ``exports``, ``units`` and ``calls`` explode.
"""

from __future__ import annotations

import bisect
import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from lithoscope.sources.batches import rows_by_text
from lithoscope.sources.lexer import BEFORE_OPERAND, Token, lex
from lithoscope.sources.schemas import CODE_UNITS

UNIT_FIELDS = CODE_UNITS.removeprefix("file_path string, ")
IMPORTS = "array<struct<source:string,specifiers:array<string>,is_external:boolean>>"
EXPORTS = "array<struct<name:string,is_default:boolean,is_re_export:boolean,source:string>>"


def _struct(ddl: str) -> str:
    """A list of fields as a struct type."""
    depth, fields, now = 0, [], ""
    for c in ddl:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            fields.append(now)
            now = ""
        else:
            now += c
    return "struct<" + ",".join(":".join(f.strip().split(" ", 1)) for f in [*fields, now]) + ">"


RESULT = (
    f"path string, error string, imports {IMPORTS}, exports {EXPORTS}, units array<{_struct(UNIT_FIELDS)}>, "
    "calls array<struct<caller_name:string,target_name:string,pos:int>>, top_level array<struct<name:string,kind:string>>, is_module boolean"
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "async", "override", "declare", "accessor"}
STATEMENTS = {
    "const": "variable-def", "let": "variable-def", "var": "variable-def", "if": "conditional",
    "for": "loop", "while": "loop", "do": "loop", "return": "return",
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&&=", "||=", "??=", "&=", "|=", "^="}
NODES = {
    "new": "NewExpression", "return": "ReturnStatement", "if": "IfStatement", "for": "ForStatement", "while": "WhileStatement", "await": "AwaitExpression",
    "switch": "SwitchStatement", "case": "SwitchCase", "try": "TryStatement", "catch": "CatchClause", "throw": "ThrowStatement", "this": "ThisExpression",
    "const": "VariableDeclaration", "let": "VariableDeclaration", "var": "VariableDeclaration", "function": "FunctionExpression",
}
NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "super", "await", "import", "constructor", "async"}


class Source:
    """One file's tokens and what is read from them."""

    def __init__(self, text: str):
        self.text = text
        self.t: list[Token] = lex(text)[0]
        self.n = len(self.t)
        self.newlines = [i for i, c in enumerate(text) if c == "\n"]
        self.pair = self._pairs()
        self.heads: set[int] = set()  # brackets of parameters of members

    def _pairs(self) -> dict[int, int]:
        stack, pair = [], {}
        for i, x in enumerate(self.t):
            if x.kind == "punct":
                if x.text in OPEN:
                    stack.append(i)
                elif x.text in CLOSE:
                    while stack and OPEN[self.t[stack[-1]].text] != x.text:
                        stack.pop()
                    if stack:
                        pair[stack.pop()] = i
        return pair

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < self.n and self.t[i].text in texts and self.t[i].kind in ("punct", "id")

    def name(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < self.n and self.t[i].kind == "id" else None

    def string(self, i: int) -> str | None:
        return self.t[i].text[1:-1] if 0 <= i < self.n and self.t[i].kind == "str" else None

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.newlines, self.t[i].start) + 1

    def after(self, i: int) -> int:
        """The place after the token at ``i``, or after its closing bracket."""
        return self.pair.get(i, i) + 1

    def angles(self, i: int) -> int:
        """The place after ``<...>`` at ``i``; ``i`` itself if there is none."""
        if not self.is_(i, "<"):
            return i
        depth, j = 0, i
        while j < self.n:
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if not depth:
                    return j + 1
            elif self.is_(j, ";"):
                return i
            j = self.after(j)
        return i

    def span(self, i: int, j: int) -> str:
        return self.text[self.t[i].start : self.t[j - 1].end] if i < j <= self.n else ""

    def until(self, i: int, *stops: str, end: int | None = None) -> int:
        """The next of ``stops`` outside brackets and angles."""
        end = self.n if end is None else end
        while i < end and not self.is_(i, *stops):
            j = self.angles(i)
            i = j if j > i else self.after(i)
        return min(i, end)

    def parts(self, i: int, end: int, stop: str = ",") -> list[tuple[int, int]]:
        out = []
        while i < end:
            j = self.until(i, stop, end=end)
            if j > i:
                out.append((i, j))
            i = j + 1
        return out

    # Imports and exports

    def specifiers(self, i: int, end: int) -> list[tuple[str, str]]:
        """``(name, local or exported name)`` of the braces between ``i`` and ``end``."""
        out = []
        for a, b in self.parts(i, end):
            if self.is_(a, "type") and b - a > 1 and not self.is_(a + 1, "as"):
                a += 1
            name = self.name(a) or self.string(a)
            if name:
                out.append((name, self.name(b - 1) or self.string(b - 1) or name))
        return out

    def read_modules(self) -> tuple[list[dict], list[dict], bool]:
        imports, exports, module = [], [], False
        add = lambda source, names: imports.append({"source": source, "specifiers": names, "is_external": not source.startswith(".")})
        export = lambda name, default=False, source=None: exports.append({"name": name, "is_default": default, "is_re_export": source is not None, "source": source})
        depth_end, i = -1, 0
        while i < self.n:
            if i <= depth_end or self.is_(i - 1, "."):
                pass
            elif self.is_(i, "import") and not self.is_(i + 1, "(", "."):
                module = True
                j, names = i + 1, []
                if self.is_(j, "type") and not self.is_(j + 1, "from", ","):
                    j += 1
                while j < self.n and self.string(j) is None and not self.is_(j, ";"):
                    if self.is_(j, "{"):
                        names += [n for n, _ in self.specifiers(j + 1, self.pair.get(j, j + 1))]
                    elif self.is_(j, "*"):
                        names.append("*")
                        j += 2
                    elif self.name(j) and not self.is_(j, "from", "as"):
                        names.append("default")
                    j = self.after(j)
                if (source := self.string(j)) is not None:
                    add(source, names)
                i = j
            elif self.is_(i, "export"):
                module = True
                i = self._export(i, add, export)
            i += 1
        seen = {x["source"] for x in imports}
        for i in range(self.n):
            if self.is_(i, "require") and self.is_(i + 1, "(") and self.string(i + 2) is not None and self.is_(i + 3, ")") and not self.is_(i - 1, "."):
                if (source := self.string(i + 2)) not in seen:
                    seen.add(source)
                    add(source, ["default"])
            if self.is_(i, "exports") and not (self.is_(i - 1, ".") and not self.is_(i - 2, "module")):
                own = self.is_(i - 1, ".")
                if self.is_(i + 1, ".") and self.name(i + 2) and self.is_(i + 3, "="):
                    export(self.name(i + 2))
                elif own and self.is_(i + 1, "="):
                    export("default", True)
        return imports, exports, module

    def _export(self, i: int, add, export) -> int:
        j = i + 1
        if self.is_(j, "type") and self.is_(j + 1, "{", "*"):
            j += 1
        if self.is_(j, "{"):
            end = self.pair.get(j, j)
            names = self.specifiers(j + 1, end)
            source = self.string(end + 2) if self.is_(end + 1, "from") else None
            for name, shown in names:
                export(shown, shown == "default", source)
                if source is not None:
                    add(source, [name])
            return end + 2 if source is not None else end
        if self.is_(j, "*"):
            k = j + 1
            shown = self.name(k + 1) if self.is_(k, "as") else "*"
            k += 2 if self.is_(k, "as") else 0
            if self.is_(k, "from") and (source := self.string(k + 1)) is not None:
                export(shown, False, source)
                add(source, ["*"])
            return k + 1
        default = self.is_(j, "default")
        j += default
        while self.is_(j, "async", "abstract", "declare", "@"):
            j += 2 if self.is_(j, "@") else 1
        if default:
            k = j + 1 + self.is_(j + 1, "*")
            export("default", True)
            if self.is_(j, "function", "class") and self.name(k) and not self.is_(k, "extends", "implements"):
                export(self.name(k))
        elif self.is_(j, "const", "let", "var") and not self.is_(j + 1, "enum"):
            for a, b in self.parts(j + 1, self.until(j + 1, ";")):
                if self.name(a) and (a == j + 1 or self.is_(a + 1, "=", ":")):
                    export(self.name(a))
                elif self.is_(a, "{", "["):
                    for x, _ in self.parts(a + 1, self.pair.get(a, a)):
                        if self.name(x):
                            export(self.name(x))
        else:
            k = j + 1 + self.is_(j + 1, "*", "enum")
            if self.is_(j, "function", "class", "interface", "type", "enum", "const", "namespace") and self.name(k):
                export(self.name(k))
        return j

    # Units

    def params(self, i: int) -> list[dict]:
        """Parameters of the round bracket at ``i``."""
        out = []
        for a, b in self.parts(i + 1, self.pair.get(i, i)):
            while a < b and (self.is_(a, "@") or (self.name(a) in MODIFIERS and a + 1 < b and (self.name(a + 1) or self.is_(a + 1, "{", "[")))):
                if self.is_(a, "@"):
                    a += 2
                    a = self.after(a) if self.is_(a, "(") else a
                else:
                    a += 1
            a += self.is_(a, "...")
            name = self.name(a) or "?"
            k = self.after(a)
            k += self.is_(k, "?")
            kind = "unknown"
            if k < b and self.is_(k, ":"):
                kind = self.span(k + 1, self.until(k + 1, "=", end=b)) or "unknown"
            out.append({"name": name, "type": kind})
        return out

    def return_type(self, i: int) -> tuple[str, int]:
        """The type after a parameter list that ends before ``i``, and the place of the body or arrow."""
        if not self.is_(i, ":"):
            return "", i
        a = j = i + 1
        while j < self.n and not self.is_(j, "=>", ";", "{") or j == a:
            k = self.angles(j)
            j = k if k > j else self.after(j)
            if self.is_(j - 1, "|", "&", "is", "extends"):
                j = self.after(j) if self.is_(j, "{") else j
        return self.span(a, j), j

    def body(self, i: int) -> tuple[int, int]:
        """Tokens of the block at ``i``, or of an expression up to its end."""
        if self.is_(i, "{"):
            return i, self.after(i)
        j = i
        while j < self.n and not self.is_(j, ";", ",", ")", "]", "}"):
            j = self.after(j)
        return i, j

    def measures(self, a: int, b: int) -> dict:
        nodes, complexity = [], 0
        for i in range(a, min(b, self.n)):
            x = self.t[i]
            if x.kind == "id":
                jsx = self.is_(i - 1, "<") and not ((self.name(i - 2) or "return") not in BEFORE_OPERAND or self.is_(i - 2, ")", "]"))
                nodes.append("JSXElement" if jsx else NODES.get(x.text, "Identifier"))
                complexity += x.text in ("if", "for", "while", "case", "default", "catch") and not self.is_(i - 1, ".") and not self.is_(i + 1, ":")
                if x.text in ("default",) and self.is_(i + 1, ":"):
                    complexity += 1
            elif x.kind in ("num", "str", "template", "regex"):
                nodes.append({"num": "NumericLiteral", "str": "StringLiteral", "template": "TemplateLiteral", "regex": "RegExpLiteral"}[x.kind])
            elif x.text == "(" and (self.name(i - 1) and self.name(i - 1) not in NOT_CALLED or self.is_(i - 1, ")", "]")):
                nodes.append("CallExpression")
            elif x.text in ("&&", "||", "??"):
                nodes.append("LogicalExpression")
                complexity += 1
            elif x.text == "?" and not self.is_(i + 1, ":", ",", ")", "=", ";"):
                nodes.append("ConditionalExpression")
                complexity += 1
            elif x.text in ASSIGN:
                nodes.append("AssignmentExpression")
            elif x.text in ("+", "-", "*", "/", "%", "**", "===", "!==", "==", "!=", "<=", ">="):
                nodes.append("BinaryExpression")
            elif x.text == "=>":
                nodes.append("ArrowFunctionExpression")
            elif x.text in (".", "?."):
                nodes.append("MemberExpression")
        inner = (a + 1, self.pair.get(a, b)) if self.is_(a, "{") else (b, b)
        return {
            "node_types": nodes, "type_tokens": [x for x in nodes if x not in ("Identifier", "StringLiteral", "NumericLiteral")], "complexity": int(complexity),
            "statement_types": [self.classify(x, y) for x, y in self.statements(*inner)], "body_line_count": self.span(a, b).count("\n") + 1,
        }

    def statements(self, i: int, end: int) -> list[tuple[int, int]]:
        return list(self.each_statement(i, end))

    def each_statement(self, i: int, end: int):
        """Statements directly within a block: they end at a semicolon, after a block, or at a line end before a name."""
        a = i
        while i < end:
            block = self.is_(i, "{") and (i == a or self.is_(i - 1, ")", "else", "try", "finally", "do", "=>") or self.is_(a, "class", "export", "interface", "enum"))
            j = self.after(i)
            done = self.is_(i, ";") or block and not self.is_(j, "else", "catch", "finally", "while", ")", ".", ",", ";", "=", "as")
            fresh = j < end and self.line(j) > self.line(j - 1) and self.t[j].kind == "id" and self.t[j].text not in ("else", "catch", "finally", "instanceof", "in", "of") and (self.is_(j - 1, ")", "]") and not self.is_(a, "if", "for", "while") or self.t[j - 1].kind in ("id", "num", "str", "template"))
            if done or fresh or j >= end:
                if j > a and not (j - a == 1 and self.is_(a, ";")):
                    yield a, j
                a = j
            i = j

    def classify(self, a: int, b: int) -> str:
        if (kind := STATEMENTS.get(self.t[a].text)) and self.t[a].kind == "id":
            return kind
        i = a
        while i < b:
            if self.is_(i, *ASSIGN):
                return "assignment"
            if self.is_(i, "=>", "{"):
                return "other"
            i = self.after(i)
        last = b - 1 - self.is_(b - 1, ";")
        return "call" if self.is_(last, ")") and (self.name(a) or "") not in ("throw", "switch", "try", "await", "new") else "other"

    def decorators(self, i: int) -> list[dict]:
        """Decorators that end right before ``i``."""
        out = []
        while i > 0:
            j = next((o for o, c in self.pair.items() if c == i - 1 and self.is_(o, "(")), i) if self.is_(i - 1, ")") else i
            name = self.name(j - 1)
            if not name or not self.is_(j - 2, "@"):
                break
            args = [self.span(a, b) for a, b in self.parts(j + 1, i - 1)] if j != i else None
            out.append({"name": name, "args": args})
            i = j - 2
        return out[::-1]

    def members(self, i: int) -> tuple[list[dict], list[dict]]:
        """Members of the class body at ``i``, and its constructor's parameters."""
        out, built, j, end, marks = [], [], i + 1, self.pair.get(i, i), []
        while j < end:
            if self.is_(j, ";", ","):
                j += 1
                continue
            if self.is_(j, "@"):
                j += 2
                j = self.after(j) if self.is_(j, "(") else j
                continue
            marks = self.decorators(j)
            seen = set()
            while self.name(j) in MODIFIERS and not self.is_(j + 1, "(", "=", ":", ";", "?", "!"):
                seen.add(self.t[j].text)
                j += 1
            kind = {"get": "getter", "set": "setter"}.get(self.t[j].text) if not self.is_(j + 1, "(", "=", ":", ";", "?", "}") else None
            j += kind is not None
            j += self.is_(j, "*")
            name = self.name(j) or self.string(j) or self.span(j, self.after(j))
            j = self.after(j)
            j += self.is_(j, "?", "!")
            k = self.angles(j)
            base = {"name": name, "type": None, "is_async": "async" in seen, "param_count": None, "is_static": "static" in seen, "decorators": marks,
                    "visibility": next((v for v in ("private", "protected", "public") if v in seen), "private" if name.startswith("#") else "public")}
            if self.is_(k, "("):
                self.heads.add(k)
                params = self.params(k)
                out.append(base | {"kind": kind or "method", "param_count": len(params)})
                if name == "constructor":
                    built = params
                    out.append(base | {"kind": "constructor", "param_count": len(params)})
                _, j = self.return_type(self.after(k))
                j = self.after(j) if self.is_(j, "{") else self.until(j, ";", "}", end=end)
            else:
                own = None
                if self.is_(j, ":"):
                    a, j = j + 1, self._line_end(j + 1, end, "=")
                    own = self.span(a, j)
                if self.is_(j, "="):
                    j = self._line_end(j + 1, end)
                out.append(base | {"kind": "property", "type": own})
        return out, built

    def _line_end(self, i: int, end: int, *stops: str) -> int:
        """Where a property's type or value ends: at a stop, a semicolon, or a line end that no operator carries on."""
        first = True
        while i < end and not self.is_(i, ";", *stops):
            if not first and self.line(i) > self.line(i - 1) and (self.t[i].kind == "id" or self.is_(i, "@", "[")) and not self.is_(i - 1, "=", "=>", "|", "&", ",", "+", "?", ":"):
                break
            k = self.angles(i) if self.name(i - 1) else i
            i = k if k > i else self.after(i)
            first = False
        return min(i, end)

    def unit(self, i: int, name: str, kind: str, exported: set[str], **own) -> dict:
        base = {"is_async": False, "params": [], "return_type": "", "members": [], "extends": None, "implements": [], "decorators": [], "constructor_params": [],
                "type_tokens": [], "node_types": [], "statement_types": [], "body_line_count": 0, "complexity": 0}
        return base | {"name": name, "kind": kind, "line": self.line(i), "exported": name in exported} | own

    def function(self, i: int, j: int, name: str, kind: str, exported, is_async: bool) -> tuple[dict, int, int] | None:
        """A function whose parameters are at ``j``; also the place and end of its body."""
        j = self.angles(j)
        if self.is_(j, "("):
            params = self.params(j)
            returns, k = self.return_type(self.after(j))
        elif kind == "arrow" and self.name(j) and self.is_(j + 1, "=>"):
            params, returns, k = [{"name": self.name(j), "type": "unknown"}], "", j + 1
        else:
            return None
        if kind == "arrow":
            if not self.is_(k, "=>"):
                return None
            k += 1
        elif not self.is_(k, "{"):
            return None
        a, b = self.body(k)
        return self.unit(i, name, kind, exported, is_async=is_async, params=params, return_type=returns, **self.measures(a, b)), a, b

    def read_units(self, exported: set[str]) -> tuple[list[dict], list[tuple[int, int, str]]]:
        """Code units in order of their beginning, nested ones too, and the bodies of named functions."""
        units, bodies = [], []
        for i in range(self.n):
            x = self.t[i]
            if x.kind != "id" or self.is_(i - 1, ".", "?."):
                continue
            word, found = x.text, None
            if word == "function":
                k = i + 1 + self.is_(i + 1, "*")
                before = i - 1 - self.is_(i - 1, "async")
                starts = before < 0 or self.is_(before, ";", "{", "}", "export", "default", "declare", ")") or self.line(i) > self.line(before)
                if self.name(k) and starts:
                    found = self.function(i, k + 1, self.name(k), "function", exported, self.is_(i - 1, "async"))
            elif word in ("const", "let", "var") and not self.is_(i + 1, "enum") and self.name(i + 1):
                k = i + 2
                if self.is_(k, ":"):
                    k = self.until(k, "=", ";", "in", "of")
                if self.is_(k, "="):
                    k += 1
                    is_async = self.is_(k, "async")
                    k += is_async
                    if self.is_(k, "function"):
                        k += 1 + self.is_(k + 1, "*")
                        k += self.name(k) is not None
                        found = self.function(i, k, self.name(i + 1), "function", exported, is_async)
                    else:
                        found = self.function(i, k, self.name(i + 1), "arrow", exported, is_async)
            elif word == "class" and self.name(i + 1) and not self.is_(i + 1, "extends", "implements"):
                body = self.until(i + 2, "{")
                if body in self.pair:
                    heads = [j for j in range(i + 2, body) if self.is_(j, "extends", "implements")]
                    base = next((self.name(j + 1) for j in heads if self.is_(j, "extends")), None)
                    listed = next((self.parts(j + 1, body) for j in heads if self.is_(j, "implements")), [])
                    members, built = self.members(body)
                    first = i
                    while self.is_(first - 1, "export", "default", "abstract", "declare"):
                        first -= 1
                    units.append(self.unit(i, self.name(i + 1), "class", exported, members=members, constructor_params=built, extends=base, implements=[self.name(a) or "?" for a, _ in listed],
                                           decorators=self.decorators(first), **self.measures(body, self.after(body))))
            elif word == "interface" and self.name(i + 1) and self.is_(body := self.until(i + 2, "{", ";"), "{"):
                units.append(self.unit(i, self.name(i + 1), "interface", exported, members=self.members(body)[0]))
            elif word == "type" and self.name(i + 1) and self.is_(self.angles(i + 2), "="):
                units.append(self.unit(i, self.name(i + 1), "type", exported))
            elif word == "enum" and self.name(i + 1) and self.is_(i + 2, "{"):
                units.append(self.unit(i, self.name(i + 1), "enum", exported))
            if found:
                units.append(found[0])
                bodies.append((found[1], found[2], found[0]["name"]))
        return units, bodies

    def read_calls(self, bodies: list[tuple[int, int, str]]) -> list[dict]:
        out, order = [], sorted(bodies)
        stack, at = [], 0
        for i in range(self.n):
            while at < len(order) and order[at][0] <= i:
                stack.append(order[at])
                at += 1
            while stack and stack[-1][1] <= i:
                stack.pop()
            if i not in self.heads and self.is_(i, "(") and (name := self.name(i - 1)) and name not in NOT_CALLED and not self.is_(i - 2, "function", "new"):
                owner = self.name(i - 3) if self.is_(i - 2, ".", "?.") and not self.is_(i - 4, ".", "?.") else None
                target = f"{owner}.{name}" if owner and owner != "this" else name
                if not self.is_(self.after(i), "{") or not self.is_(i - 2, ",", "{"):  # an object literal's method
                    out.append({"caller_name": stack[-1][2] if stack else "<module>", "target_name": target, "pos": self.t[i - 1].start})
        return out

    def read_top_level(self) -> list[dict]:
        out, i = [], 0
        while i < self.n:
            word = self.name(i)
            k = i + 1 + self.is_(i + 1, "*")
            if word == "const" and self.is_(i + 1, "enum"):
                i += 1
                continue
            if word in ("const", "let", "var"):
                for a, _ in self.parts(i + 1, self.until(i + 1, ";")):
                    if self.name(a) and (a == i + 1 or self.is_(a + 1, "=", ":") and self.is_(a - 1, ",")):
                        out.append({"name": self.name(a), "kind": "variable"})
                i += 2
                continue
            if word in ("function", "class", "interface", "enum") and self.name(k) or word == "type" and self.name(k) and self.is_(self.angles(k + 1), "="):
                out.append({"name": self.name(k), "kind": word})
            i = self.after(i)
        return out

    def result(self, path: str) -> dict:
        imports, exports, module = self.read_modules()
        units, bodies = self.read_units({x["name"] for x in exports if not x["is_re_export"]})
        return {"path": path, "error": None, "imports": imports, "exports": exports, "units": units, "calls": self.read_calls(bodies), "top_level": self.read_top_level(), "is_module": module}


def extract_text(path: str, text: str) -> dict:
    """All records of one file; a failure becomes its ``error``."""
    try:
        return Source(text).result(path)
    except (IndexError, KeyError, RecursionError, ValueError) as e:
        return {"path": path, "error": f"{type(e).__name__}: {e}", "imports": [], "exports": [], "units": [], "calls": [], "top_level": [], "is_module": False}


def extract_all(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each of ``files(path, text)`` with arrays of its records; read in parallel, errors as rows.

    ``columns`` names those that are wanted beside the path; every file is read as a whole all the same.
    """
    fields = StructType.fromDDL(RESULT).fields[1:]
    wanted = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields if columns is None or f.name in columns)
    return rows_by_text(files, "path", wanted, lambda text: [extract_text("", text)])


def units(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("path").alias("file_path"), F.explode("units").alias("u")).select("file_path", "u.*")


def calls(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("path").alias("file_path"), F.explode("calls").alias("c")).select("file_path", "c.*")


def imports(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.explode("imports").alias("i")).select("path", "i.*")


def exports(extracted: DataFrame) -> DataFrame:
    return extracted.select("path", F.explode("exports").alias("e")).select("path", "e.*")


def light_units(extracted: DataFrame) -> DataFrame:
    """Top-level names with their kinds; exported if the name itself is exported."""
    names = F.transform("exports", lambda e: e["name"])
    return extracted.select(F.col("path").alias("file_path"), F.explode("top_level").alias("t"), names.alias("n")).select("file_path", "t.*", F.array_contains("n", F.col("t.name")).alias("exported"))


@F.pandas_udf(StringType())
def joined_path(directory: pd.Series, source: pd.Series) -> pd.Series:
    """A relative specifier against the folder of its importer, normalised."""
    return pd.Series([posixpath.normpath(posixpath.join(d, s)) for d, s in zip(directory, source)], directory.index, dtype=object)


def required_at_top(text: str) -> list[str]:
    """Modules whose ``require`` is the value of a variable declared at top level; requires elsewhere don't count."""
    s, out, i = Source(text), [], 0
    while i < s.n:
        if s.is_(i, "=") and s.is_(i + 1, "require") and s.is_(i + 2, "(") and s.string(i + 3) is not None and s.is_(i + 4, ")") and (s.name(i - 1) or s.is_(i - 1, "}", "]")) and not s.is_(i - 2, "."):
            if (source := s.string(i + 3)) not in out:
                out.append(source)
        i = s.after(i)
    return out


def shallow_requires(files: DataFrame) -> DataFrame:
    """``path, source`` of ``files(path, text)`` by ``required_at_top``; a text that can't be read requires nothing here (its error
    stands in ``extract_all``)."""

    def read(text):
        try:
            return [{"source": x} for x in required_at_top(text)]
        except (IndexError, KeyError, RecursionError, ValueError):
            return []

    return rows_by_text(files, "path", "source string", read)
