"""Names of one file: import declarations, top-level declarations, bindings with their scopes, and references.

A binding is visible in a range of tokens; a reference belongs to the innermost binding of its name around it. There is no
type checker: members of objects, and names that reach a file through more than one import, are not resolved.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.sources.extract import ASSIGN, Source

DECLARE = ("const", "let", "var")
NAMED = ("function", "class", "interface", "type", "enum")
PREFIXES = ("export", "default", "declare", "abstract", "async")
#: Before a brace that opens an object, a type or a pattern rather than a block.
BEFORE_OBJECT = ("(", ",", "=", ":", "[", "?", "|", "&", "<", "return", "import", "export", "type", *DECLARE, "||", "&&", "??", "...", "of", "in", "default")


@dataclass
class Import:
    """An import declaration from token ``a`` up to ``b``."""

    a: int
    b: int
    source: str
    quote: str = "'"
    default: str | None = None
    namespace: str | None = None
    named: list[tuple[str, str]] = field(default_factory=list)
    type_only: bool = False

    def locals(self) -> list[str]:
        return [x for x in (self.default, self.namespace) if x] + [local for _, local in self.named]

    def text(self) -> str:
        named = "{ " + ", ".join(n if n == x else f"{n} as {x}" for n, x in self.named) + " }" if self.named else None
        heads = [x for x in (self.default, f"* as {self.namespace}" if self.namespace else None, named) if x]
        return f"import {'type ' if self.type_only else ''}{', '.join(heads)}{' from ' if heads else ''}{self.quote}{self.source}{self.quote};"


@dataclass
class Declaration:
    """A top-level declaration: its first token (decorators and ``export`` included), its keyword, its name, its end."""

    a: int
    word: int
    name_at: int
    b: int
    name: str
    kind: str
    prefixes: set[str]
    siblings: int = 1


def import_declarations(s: Source) -> list[Import]:
    out, i = [], 0
    while i < s.n:
        if s.is_(i, "import") and not s.is_(i + 1, "(", ".") and not s.is_(i - 1, "."):
            d, j = Import(i, i, ""), i + 1
            if s.is_(j, "type") and not s.is_(j + 1, "from", ","):
                d.type_only, j = True, j + 1
            while j < s.n and s.string(j) is None and not s.is_(j, ";"):
                if s.is_(j, "{"):
                    d.named += s.specifiers(j + 1, s.pair.get(j, j + 1))
                elif s.is_(j, "*") and s.is_(j + 1, "as"):
                    d.namespace, j = s.name(j + 2), j + 2
                elif s.name(j) and not s.is_(j, "from"):
                    d.default = s.name(j)
                j = s.after(j)
            if s.string(j) is not None:
                d.source, d.quote, d.b = s.string(j), s.t[j].text[0], j + 1 + s.is_(j + 1, ";")
                out.append(d)
            i = j
        i = s.after(i)
    return out


def declarations(s: Source) -> list[Declaration]:
    """Top-level declarations in order; each declarator of a variable statement is one."""
    out, i = [], 0
    while i < s.n:
        a = i
        while s.is_(i, "@") and s.name(i + 1):
            i += 2
            i = s.after(i) if s.is_(i, "(") else i
        seen = set()
        while s.is_(i, *PREFIXES) and not s.is_(i + 1, "=", ".", "(", ":"):
            seen.add(s.t[i].text)
            i += 1
        found = declared(s, a, i, seen) if not s.is_(a - 1, ".") else []
        out += found
        i = max(found[-1].b, i + 1) if found else s.after(i)
    return out


def declared(s: Source, a: int, i: int, seen: set[str]) -> list[Declaration]:
    """Declarations whose keyword is at ``i``."""
    word = s.name(i)
    if word in DECLARE and not s.is_(i + 1, "enum"):
        out, j = [], i + 1
        while j < s.n:
            at, k = j, s.after(j)
            k += s.is_(k, "!")
            if s.is_(k, ":"):
                k = s._line_end(k + 1, s.n, "=", ",")
            if s.is_(k, "="):
                k = s._line_end(k + 1, s.n, ",")
            out.append(Declaration(a, i, at, k, s.name(at) or s.span(at, s.after(at)), "variable", seen))
            j = k + 1
            if not s.is_(k, ","):
                break
        end = k + s.is_(k, ";")
        for d in out:
            d.b, d.siblings = end, len(out)
        return out
    i += word == "const"
    word = s.name(i)
    k = i + 1 + s.is_(i + 1, "*")
    if word not in NAMED or not s.name(k):
        return []
    if word == "function":
        p = s.angles(k + 1)
        if not s.is_(p, "("):
            return []
        _, body = s.return_type(s.after(p))
        end = s.after(body) if s.is_(body, "{") else body + s.is_(body, ";")
    elif word == "type":
        eq = s.angles(k + 1)
        if not s.is_(eq, "="):
            return []
        end = s._line_end(eq + 1, s.n)
        end += s.is_(end, ";")
    else:
        body = s.until(k + 1, "{", ";")
        if not s.is_(body, "{"):
            return []
        end = s.after(body)
    return [Declaration(a, i, k, end, s.name(k), word, seen)]


def declaration(s: Source, name: str) -> Declaration | None:
    return next((d for d in declarations(s) if d.name == name), None)


class Names:
    """Bindings and references of a file."""

    def __init__(self, s: Source):
        self.s = s
        self.around, stack = [-1] * s.n, []
        for i in range(s.n):
            while stack and s.pair[stack[-1]] <= i:
                stack.pop()
            self.around[i] = stack[-1] if stack else -1
            if i in s.pair:
                stack.append(i)
        self.bodies = self._class_bodies()
        self.bindings: dict[str, list[tuple[int, int, int]]] = {}
        self._bind()

    def _class_bodies(self) -> set[int]:
        s, out = self.s, set()
        for i in range(s.n):
            if s.is_(i, "class", "interface", "enum") and not s.is_(i - 1, ".") and (s.name(i + 1) or s.is_(i + 1, "{")):
                body = s.until(i + 1, "{", ";", "=")
                if s.is_(body, "{"):
                    out.add(body)
        return out

    @cached_property
    def brackets(self) -> dict[int, int]:
        return {c: o for o, c in self.s.pair.items()}

    def is_block(self, i: int) -> bool:
        """Whether the brace at ``i`` holds statements."""
        return i not in self.bodies and not self.s.is_(i - 1, *BEFORE_OBJECT)

    def block(self, i: int) -> tuple[int, int]:
        """The innermost block or head of a loop around ``i``."""
        s, o = self.s, self.around[i]
        while o >= 0:
            if s.is_(o, "{") and self.is_block(o):
                return o, s.after(o)
            if s.is_(o, "(") and (s.is_(o - 1, "for") or s.is_(o - 1, "await") and s.is_(o - 2, "for")):
                return o, self._statement_end(s.after(o))
            o = self.around[o]
        return -1, s.n

    def _statement_end(self, i: int) -> int:
        s = self.s
        return s.after(i) if s.is_(i, "{") else s._line_end(i, s.n)

    def add(self, at: int, scope: tuple[int, int]) -> None:
        if self.s.name(at):
            self.bindings.setdefault(self.s.name(at), []).append((*scope, at))

    def pattern(self, i: int, scope: tuple[int, int]) -> None:
        """Names that the pattern at ``i`` binds."""
        s = self.s
        if s.name(i):
            return self.add(i, scope)
        for a, b in s.parts(i + 1, s.pair.get(i, i)):
            a += s.is_(a, "...")
            if s.is_(i, "{") and s.is_(s.after(a), ":"):
                a = s.after(a) + 1
            self.pattern(a, scope) if s.name(a) or s.is_(a, "{", "[") else None

    def _bind(self) -> None:
        s = self.s
        for d in import_declarations(s):
            for i in range(d.a, d.b):
                if s.name(i) in d.locals() and not s.is_(i + 1, "as") and not s.is_(i, "from", "import"):
                    self.add(i, (-1, s.n))
        for i in range(s.n):
            if s.is_(i - 1, ".", "?."):
                continue
            if s.is_(i, *DECLARE) and not s.is_(i + 1, "enum", ":", "=", ","):
                scope, j = self.block(i), i + 1
                while j < s.n:
                    self.pattern(j, scope)
                    k = s.after(j)
                    if s.is_(k, ":"):
                        k = s._line_end(k + 1, s.n, "=", ",", ")")
                    if s.is_(k, "="):
                        k = s._line_end(k + 1, s.n, ",", ")", "]", "}")
                    if not s.is_(k, ","):
                        break
                    j = k + 1
            elif s.is_(i, *NAMED) and s.name(k := i + 1 + s.is_(i + 1, "*")) and not s.is_(k, "extends", "implements", "from", "of", "in"):
                if not s.is_(i, "type") or s.is_(s.angles(k + 1), "="):
                    self.add(k, self.block(i))
            elif s.is_(i, "("):
                end = s.after(i)
                if s.is_(i - 1, "if", "for", "while", "switch"):
                    continue
                if s.is_(end, "=>", "{") or s.is_(end, ":") and self._typed_head(i):
                    _, body = s.return_type(end)
                    arrow = s.is_(body, "=>")
                    if arrow or s.is_(body, "{"):
                        last = self._expression_end(body + 1) if arrow else s.after(body)
                        for a, _ in s.parts(i + 1, s.pair[i]) if i in s.pair else []:
                            while s.is_(a, "@", "public", "private", "protected", "readonly", "...") and not s.is_(a + 1, ":", ",", ")", "?", "="):
                                a += 2 if s.is_(a, "@") else 1
                            self.pattern(a, (i, last)) if s.name(a) or s.is_(a, "{", "[") else None
            elif s.name(i) and s.is_(i + 1, "=>"):
                self.add(i, (i - 1, self._expression_end(i + 2)))

    def _typed_head(self, i: int) -> bool:
        """Whether the bracket at ``i``, before a colon, can be parameters rather than an operand of a ternary."""
        o, s = i - 1, self.s
        while o >= 0 and not s.is_(o, ";", "{", "}", "(", ",", "=", "=>", ":"):
            if s.is_(o, "?"):
                return False
            o = self.brackets.get(o, o) - 1
        return True

    def _expression_end(self, i: int) -> int:
        return self.s.after(i) if self.s.is_(i, "{") else self.s.body(i)[1]

    def is_key(self, i: int) -> bool:
        """Whether the name at ``i`` names a member: after a dot, or as a key of an object, type, class or pattern."""
        s, o = self.s, self.around[i]
        if s.is_(i - 1, ".", "?."):
            return True
        if o < 0 or not s.is_(o, "{") or self.is_block(o):
            return False
        first = s.is_(i - 1, "{", ",", ";", "}", "static", "readonly", "public", "private", "protected", "abstract", "async", "get", "set", "override", "*") or s.line(i) > s.line(i - 1) and o in self.bodies
        nexts = ("(", ":", "?", "!", "=", ";", "}", "<", ",") if o in self.bodies else ("(", ":", "?")
        return first and s.is_(i + 1, *nexts)

    def owner(self, i: int) -> tuple[int, int, int] | None:
        """The innermost binding of the name at ``i``."""
        inside = [b for b in self.bindings.get(self.s.t[i].text, []) if b[0] <= i < b[1] or b[2] == i]
        return min(inside, key=lambda b: (b[1] - b[0], b[2]), default=None)

    def references(self, name: str, binding: int | None = None) -> list[int]:
        """Places of ``name`` that mean the binding at token ``binding`` (the top-level one by default), itself left out."""
        out = []
        for i in range(self.s.n):
            if self.s.t[i].kind == "id" and self.s.t[i].text == name and not self.is_key(i):
                own = self.owner(i)
                if own is None or i == own[2]:
                    continue
                if own[2] == binding if binding is not None else own[0] < 0:
                    out.append(i)
        return out

    def shorthand(self, i: int) -> bool:
        """Whether the name at ``i`` is both key and value of an object."""
        s, o = self.s, self.around[i]
        return o >= 0 and s.is_(o, "{") and not self.is_block(o) and o not in self.bodies and not s.is_(o - 1, "import", "export", "type") and s.is_(i - 1, "{", ",") and s.is_(i + 1, "}", ",")

    def context(self, i: int) -> str:
        """What the reference at ``i`` is used for."""
        s, o = self.s, self.around[i]
        if any(b[2] == i for b in self.bindings.get(s.t[i].text, [])) and not self.in_module_braces(i, "import"):
            return "definition"
        if o >= 0 and s.is_(o, "{") and s.is_(o - 1, "=") and s.name(o - 2) and self._in_tag(o):
            return "jsx-attribute"
        if s.is_(i - 1, "<") and not s.name(i - 2) and not s.is_(i - 2, ")", "]") or s.is_(i - 1, "/") and s.is_(i - 2, "<"):
            return "jsx-element"
        if o >= 0 and s.is_(o, "{") and s.is_(o - 1, ">") and s.is_(s.after(o), "<"):
            return "jsx-expression"
        if o >= 0 and s.is_(o, "(") and s.t[o].start == s.t[o].end:
            return "template-expression"
        if s.is_(i - 1, "@"):
            return "decorator"
        if self.in_module_braces(i, "import") or s.is_(i - 1, "import"):
            return "import"
        if self.in_module_braces(i, "export"):
            return "export"
        if s.is_(i - 1, ":", "|", "&", "<", "as", "extends", "implements", "keyof") and not self._in_object(i) and not s.is_(i + 1, "("):
            return "type-annotation"
        if s.is_(i - 1, "..."):
            return "spread"
        if o >= 0 and s.is_(i - 1, "{", ",", "[") and s.is_(o - 1, *DECLARE):
            return "destructure"
        if o >= 0 and s.is_(o, "(") and s.is_(i - 1, "(", ",") and s.is_(i + 1, ")", ",") and (s.name(o - 1) or s.is_(o - 1, ")", "]", ">")):
            return "call-argument"
        if s.is_(i - 1, "return"):
            return "return-value"
        if s.is_(i + 1, *ASSIGN):
            return "assignment"
        return "property-access" if s.is_(i + 1, ".", "?.") else "usage"

    def in_module_braces(self, i: int, word: str) -> bool:
        s, o = self.s, self.around[i]
        if o < 0 or not s.is_(o, "{"):
            return False
        j = o - 1
        while s.is_(j, ",", "type") or s.name(j) and s.is_(j + 1, ",") and s.is_(j - 1, "import", "type"):
            j -= 1
        return s.is_(j, word)

    def _in_object(self, i: int) -> bool:
        o = self.around[i]
        return self.s.is_(i - 1, ":") and o >= 0 and self.s.is_(o, "{") and not self.is_block(o) and o not in self.bodies and self.s.is_(o - 1, "(", ",", "=", "return", "[", "?", "...", "||", "&&", "??")

    def _in_tag(self, o: int) -> bool:
        """Whether the brace at ``o`` is the value of an attribute."""
        j = o - 2
        while j > 0 and not self.s.is_(j, ";", "{", "(", "<", ")"):
            j = self.brackets.get(j, j) - 1
        return self.s.is_(j, "<")


REFERENCES = "path string, name string, pos int, line int, context string, is_write boolean, text string"
#: Characters of a reference's line that are shown.
CONTEXT_CHARS = 80


def rows_of(path: str, text: str, wanted: dict[str, str]) -> list[dict]:
    """References in one file to local names, each under the name it stands for (``wanted``: local -> name)."""
    s = Source(text)
    names, out = Names(s), []
    for local, name in wanted.items():
        own = [b[2] for b in names.bindings.get(local, []) if b[0] < 0]
        for i in sorted({*names.references(local), *own}):
            kind = names.context(i)
            line = text[text.rfind("\n", 0, s.t[i].start) + 1 :].split("\n", 1)[0].strip()
            out.append({"path": path, "name": name, "pos": s.t[i].start, "line": s.line(i), "context": kind, "is_write": kind in ("definition", "assignment"), "text": line[:CONTEXT_CHARS]})
    return out


def local_names(s: Source, sources: set[str], name: str, default: bool = False) -> dict[str, str]:
    """Local names under which a file imports ``name`` (or the default export) by one of ``sources``."""
    found = {}
    for d in import_declarations(s):
        if d.source in sources:
            found |= {local: name for shown, local in d.named if shown == name or default and shown == "default"}
            if default and d.default:
                found[d.default] = name
    return found


def find_references(files: DataFrame, edges: DataFrame, path: str, name: str, default: bool = False) -> DataFrame:
    """References to the top-level ``name`` of file ``path`` in it and in the files that import it directly.

    ``edges(src, source, dst)`` are resolved imports; ``default`` says that the name is the file's default export. Re-exports count as ``export`` references of their file.
    """
    by = edges.where((F.col("dst") == path) & (F.col("src") != path)).groupBy(F.col("src").alias("path")).agg(F.collect_set("source").alias("sources"))
    rows = files.select("path", "text").join(by, "path", "left").where((F.col("path") == path) | F.col("sources").isNotNull())

    def run(batches):
        for b in batches:
            out = []
            for p, text, sources in zip(b["path"], b["text"], b["sources"]):
                try:
                    s = Source(text or "")
                    if p == path:
                        out += rows_of(p, text or "", {name: name})
                    else:
                        out += rows_of(p, text or "", local_names(s, set(sources), name, default))
                        out += re_exports(p, text or "", s, set(sources), name)
                except (IndexError, KeyError, RecursionError):
                    continue
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, REFERENCES)


def re_exports(path: str, text: str, s: Source, sources: set[str], name: str) -> list[dict]:
    out = []
    for i in range(s.n):
        if s.is_(i, "export") and s.is_(o := i + 1 + s.is_(i + 1, "type"), "{") and s.is_(s.after(o), "from") and s.string(s.after(o) + 1) in sources:
            for a, _ in s.parts(o + 1, s.pair[o]):
                if s.name(a) == name:
                    out.append({"path": path, "name": name, "pos": s.t[a].start, "line": s.line(a), "context": "export", "is_write": False, "text": s.span(i, s.after(o) + 2)[:CONTEXT_CHARS]})
    return out
