"""Rewrites of source text, planned as edits ``(start, end, replacement)`` of characters.

A rewrite is a pair of functions: one for the file that holds the symbol, one for each file that imports it. Both see the
holder's text, so that every file can be planned apart from the others; what must not be done raises ``Refused``, in
every file alike where it depends on the holder. Names are resolved as in ``names``, without a type checker: a member's
type that is not written down is left out of interfaces, and uses through a barrel file are not followed.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from lithoscope.sources.extract import Source
from lithoscope.sources.names import DECLARE, Declaration, Import, Names, declaration, declarations, import_declarations, local_names

Edit = tuple[int, int, str]
#: Operators that part an expression; modifiers in their order before a declaration's keyword.
OPERATORS = ("+", "-", "*", "/", "%", "**", "==", "===", "!=", "!==", "<", ">", "<=", ">=", "&&", "||", "??", "&", "|", "^", "in", "instanceof", "?", ":", ",", "=>")
MODIFIER_ORDER = ("export", "default", "declare", "abstract", "async")


class Refused(ValueError):
    """A precondition does not hold."""


@dataclass
class File:
    """A file to be planned: the specifiers by which it imports the holder, and the holder (itself, if it is the one)."""

    path: str
    text: str
    sources: set[str] = field(default_factory=set)
    holder_path: str = ""
    holder_text: str | None = None

    def __post_init__(self):
        self.s = Source(self.text)
        self.own = self.holder_text is None or self.path == self.holder_path
        self.holder = self.s if self.own else Source(self.holder_text)
        self._names = None

    @property
    def names(self) -> Names:
        self._names = self._names or Names(self.s)
        return self._names

    def at(self, i: int) -> int:
        return self.s.t[i].start if i < self.s.n else len(self.text)

    def end(self, b: int) -> int:
        """Where the token before ``b`` ends."""
        return self.s.t[b - 1].end if b else 0


def apply(text: str, edits: list[Edit]) -> str:
    """``text`` after the edits, from the last to the first; equal insertions keep their order."""
    for a, b, new in sorted(edits, key=lambda e: (e[0], e[1]), reverse=True):
        text = text[:a] + new + text[b:]
    return text


def need(s: Source, name: str, *kinds: str) -> Declaration:
    found = declaration(s, name)
    if not found or kinds and found.kind not in kinds:
        raise Refused(f"{'/'.join(kinds) or 'symbol'} '{name}' not found")
    return found


def name_at(text: str, line: int, column: int) -> str:
    """The name at a place (from 1)."""
    s = Source(text)
    lines = text.split("\n")
    at = sum(len(x) + 1 for x in lines[: line - 1]) + column - 1
    found = next((x.text for x in s.t if x.kind == "id" and x.start <= at < x.end), None)
    if not found:
        raise Refused("no identifier at position")
    return found


# Pieces of declarations


@dataclass
class Head:
    """A function's parameters (bracket tokens), return type and body."""

    p: int
    close: int
    returns: str
    returns_end: int
    body: int

    @staticmethod
    def of(s: Source, at: int) -> Head:
        p = s.angles(at + 1)
        close = s.pair.get(p, p)
        returns, body = s.return_type(close + 1)
        return Head(p, close, returns, body, body)


def parameter_texts(s: Source, p: int) -> list[str]:
    return [s.span(a, b) for a, b in s.parts(p + 1, s.pair.get(p, p))]


def single_return(s: Source, body: int) -> str | None:
    """The expression of a block that is one return; an empty text for a return of nothing."""
    end = s.pair.get(body, body)
    if not s.is_(body + 1, "return"):
        return None
    stop = s._line_end(body + 2, end)
    rest = stop + s.is_(stop, ";")
    return s.span(body + 2, stop) if rest >= end else None


def removal(f: File, d: Declaration, comments: bool = False) -> Edit:
    """The edit that takes a declaration out, with its line's end and, if asked, the comments right above it."""
    if d.siblings > 1:
        return declarator_removal(f, d)
    a, b = f.at(d.a), f.end(d.b)
    if comments:
        a -= len(leading_comments(f.text, a))
    start = f.text.rfind("\n", 0, a) + 1
    a = start if not f.text[start:a].strip() else a
    m = re.compile(r"[ \t]*(?://[^\n]*)?\r?\n?").match(f.text, b)
    return a, m.end() if a == start else b, ""


def declarator_removal(f: File, d: Declaration) -> Edit:
    all_of = [x for x in declarations(f.s) if x.a == d.a]
    k = next(i for i, x in enumerate(all_of) if x.name_at == d.name_at)
    if k + 1 < len(all_of):
        return f.at(d.name_at), f.at(all_of[k + 1].name_at), ""
    last = d.b - f.s.is_(d.b - 1, ";")
    comma = next(i for i in range(d.name_at, 0, -1) if f.s.is_(i, ","))
    return f.at(comma), f.end(last), ""


def leading_comments(text: str, a: int) -> str:
    """Comment lines that end right above ``a``."""
    m = re.search(r"(?:^[ \t]*(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)[ \t]*\n)+[ \t]*$", text[:a], re.M)
    return m[0] if m else ""


def initial_value(s: Source, d: Declaration) -> str | None:
    k = s.after(d.name_at)
    k += s.is_(k, "!")
    if s.is_(k, ":"):
        k = s._line_end(k + 1, s.n, "=", ",")
    return s.span(k + 1, s._line_end(k + 1, s.n, ",")) if s.is_(k, "=") else None


# Imports


def get_imports(text: str) -> list[Import]:
    return import_declarations(Source(text))


def rendered(f: File, d: Import) -> Edit:
    """The edit that writes a changed import, or takes it out once it imports nothing."""
    if d.locals():
        return f.at(d.a), f.end(d.b), d.text()
    b = f.end(d.b)
    return f.at(d.a), b + (f.text[b : b + 1] == "\n"), ""


def added_import(f: File, source: str, names: list[str], removing: list[Import] = ()) -> list[Edit]:
    """Named imports of ``source``, merged into a declaration of it if there is one."""
    imports = [d for d in import_declarations(f.s) if d.a not in {r.a for r in removing}]
    for d in imports:
        if d.source == source and not d.namespace and not d.type_only:
            new = [n for n in names if n not in {x for x, _ in d.named}]
            d.named += [(n, n) for n in new]
            return [rendered(f, d)] if new else []
    line = Import(0, 0, source, named=[(n, n) for n in names]).text() + "\n"
    if imports:
        at = f.end(imports[-1].b)
        return [(at, at, "\n" + line[:-1])]
    at = f.text.find("\n") + 1 if f.text.startswith("#!") else 0
    return [(at, at, line)]


def removed_import(f: File, source: str, names: list[str] | None = None) -> list[Edit]:
    out = []
    for d in import_declarations(f.s):
        if d.source == source:
            if names is None:
                d.default = d.namespace = None
            d.named = [x for x in d.named if names is not None and x[0] not in names]
            out.append(rendered(f, d))
    return out


def updated_import_path(f: File, old: str, new: str) -> list[Edit]:
    out = []
    for d in import_declarations(f.s):
        if d.source == old:
            at = max(i for i in range(d.a, d.b) if f.s.string(i) is not None)
            out.append((f.at(at), f.s.t[at].end, f"{d.quote}{new}{d.quote}"))
    return out


def unused_imports(f: File, without: tuple[int, int] = (0, 0)) -> list[Edit]:
    """Edits that take out what only the tokens in ``without`` (or nothing) use; imports for effect stay."""
    out = []
    for d in import_declarations(f.s):
        used = lambda local: any(not without[0] <= i < without[1] for i in f.names.references(local))
        before = d.locals()
        d.named = [x for x in d.named if used(x[1])]
        d.default = d.default if d.default and used(d.default) else None
        d.namespace = d.namespace if d.namespace and used(d.namespace) else None
        if before != d.locals():
            out.append(rendered(f, d))
    return out


def specifier(importer: str, target: str, extension: str = "") -> str:
    """The relative specifier of ``target`` in ``importer``."""
    stem = re.sub(r"\.[cm]?[jt]sx?$", "", target)
    path = posixpath.relpath(stem, posixpath.dirname(importer)) + extension
    return path if path.startswith(".") else f"./{path}"


# Rewrites within one file


def to_arrow(f: File, name: str) -> list[Edit]:
    """A function declaration as a constant arrow function; one that uses ``this`` or generates is refused."""
    s, d = f.s, need(f.s, name, "function")
    h = Head.of(s, d.name_at)
    if not s.is_(h.body, "{"):
        raise Refused(f"function '{name}' has no body")
    if any(s.is_(i, "this", "arguments", "yield") and not s.is_(i - 1, ".") for i in range(h.body, d.b)) or s.is_(d.word + 1, "*"):
        raise Refused(f"function '{name}' uses 'this'")
    value = single_return(s, h.body)
    body = s.span(h.body, d.b) if value is None else value or "{}"
    body = f"({body})" if value and value.startswith("{") else body
    types = s.span(d.name_at + 1, h.p)
    heads = " ".join(m for m in MODIFIER_ORDER if m in d.prefixes - {"async", "default"})
    returns = f": {h.returns}" if h.returns else ""
    arrow = f"{heads + ' ' if heads else ''}const {name} = {'async ' if 'async' in d.prefixes else ''}{types}({', '.join(parameter_texts(s, h.p))}){returns} => {body};"
    after = f"\nexport default {name};" if "default" in d.prefixes else ""
    if after:
        arrow = arrow.removeprefix("export ")
    return [(f.at(d.a), f.end(d.b), arrow + after)]


def to_async(f: File, name: str) -> list[Edit]:
    """A function declaration made asynchronous, its written return type wrapped in a promise."""
    d = need(f.s, name, "function")
    if "async" in d.prefixes:
        raise Refused(f"function '{name}' is already async")
    h = Head.of(f.s, d.name_at)
    out = [(f.at(d.word), f.at(d.word), "async ")]
    if h.returns and not h.returns.startswith("Promise<"):
        a, b = f.at(h.close + 2), f.end(h.body)
        out.append((a, b, f"Promise<{h.returns}>"))
    return out


def modify(f: File, name: str, exported=None, default_export=None, is_async=None, is_abstract=None, return_type=None, add_params=(), remove_params=(),
           add_decorators=(), remove_decorators=(), declaration_kind=None) -> list[Edit]:
    """Modifiers, parameters, types and decorators of a top-level declaration. What its kind can't have is left as it is."""
    s, d, out = f.s, need(f.s, name), []
    first = d.a
    decorators = []
    while s.is_(first, "@"):
        k = s.after(first + 2) if s.is_(first + 2, "(") else first + 2
        decorators.append((s.name(first + 1), s.span(first, k)))
        first = k
    if d.kind != "variable":
        now = set(d.prefixes)
        for mark, wanted in (("export", exported), ("async", is_async if d.kind == "function" else None), ("abstract", is_abstract if d.kind == "class" else None)):
            now = now if wanted is None else now | {mark} if wanted else now - {mark}
        if exported is False:
            now -= {"default"}
        if default_export is not None and d.kind in ("function", "class", "interface"):
            now = now | {"export", "default"} if default_export else now - {"default"}
        kept = decorators
        if d.kind == "class":
            kept = [x for x in decorators if x[0] not in remove_decorators] + [(x, f"@{x}") for x in add_decorators]
        if now != d.prefixes or kept != decorators:
            heads = "".join(t + "\n" for _, t in kept) + "".join(m + " " for m in MODIFIER_ORDER if m in now)
            out.append((f.at(d.a), f.at(d.word), heads))
    elif declaration_kind:
        out.append((f.at(d.word), s.t[d.word].end, declaration_kind))
    if d.kind == "function":
        h = Head.of(s, d.name_at)
        out += parameter_edits(f, h, add_params, remove_params)
        if return_type is not None:
            out.append((f.at(h.close + 2), f.end(h.body), return_type) if h.returns else (s.t[h.close].end, s.t[h.close].end, f": {return_type}"))
    return out


def parameter_edits(f: File, h: Head, add=(), remove=()) -> list[Edit]:
    """``add`` holds ``(name, type, default or None)``; ``remove`` names."""
    if not add and not remove:
        return []
    s = f.s
    texts = [t for t, p in zip(parameter_texts(s, h.p), s.params(h.p)) if p["name"] not in remove]
    texts += [f"{n}{': ' + t if t else ''}{' = ' + v if v is not None else ''}" for n, t, v in add]
    return [(s.t[h.p].end, f.at(h.close), ", ".join(texts))]


def class_members(s: Source, d: Declaration) -> list[dict]:
    """Members of a class with their tokens: ``a`` to ``b``, ``name``, ``mods``, ``kind``, and for methods their ``head``."""
    body = s.until(d.name_at + 1, "{")
    out, j, end = [], body + 1, s.pair.get(body, body)
    while j < end:
        if s.is_(j, ";", ","):
            j += 1
            continue
        a, mods = j, set()
        while s.is_(j, "@"):
            j = s.after(j + 2) if s.is_(j + 2, "(") else j + 2
        while s.is_(j, "public", "private", "protected", "readonly", "static", "abstract", "async", "override", "declare", "get", "set", "*") and not s.is_(j + 1, "(", "=", ":", ";", "?", "!", "}"):
            mods.add(s.t[j].text)
            j += 1
        name_at = j
        k = s.after(j)
        optional = s.is_(k, "?")
        k += s.is_(k, "?", "!")
        p = s.angles(k)
        own = {"a": a, "name": s.name(name_at) or s.span(name_at, s.after(name_at)), "name_at": name_at, "mods": mods, "optional": optional, "hidden": bool(mods & {"private", "protected"}) or (s.name(name_at) or "").startswith("#")}
        if s.is_(p, "("):
            h = Head.of(s, k - 1)
            j = s.after(h.body) if s.is_(h.body, "{") else s.until(h.body, ";", "}", end=end)
            out.append(own | {"kind": "accessor" if mods & {"get", "set"} else "method", "head": h, "b": j})
        else:
            typed = None
            t_end = k
            if s.is_(k, ":"):
                t_end = s._line_end(k + 1, end, "=")
                typed = s.span(k + 1, t_end)
            j = s._line_end(t_end + 1, end) if s.is_(t_end, "=") else t_end
            out.append(own | {"kind": "property", "type": typed, "b": j, "value": s.span(t_end + 1, j) if s.is_(t_end, "=") else None})
        j = max(j, a + 1)
    return out


def literal_type(value: str | None) -> str | None:
    """The type of a plain literal."""
    if value is None:
        return None
    if re.fullmatch(r"-?\d[\d_.]*", value):
        return "number"
    return "string" if re.fullmatch(r"'[^']*'|\"[^\"]*\"|`[^`]*`", value) else "boolean" if value in ("true", "false") else None


def encapsulate(f: File, class_name: str, field_name: str) -> list[Edit]:
    """A private field of the name with an underscore, and accessors of the old name; uses through ``this`` follow."""
    s, d = f.s, need(f.s, class_name, "class")
    m = next((m for m in class_members(s, d) if m["name"] == field_name and m["kind"] == "property"), None)
    if not m:
        raise Refused(f"field '{field_name}' not found in class '{class_name}'")
    kind = m["type"] or literal_type(m["value"]) or "any"
    mods = [x for x in ("static", "readonly") if x in m["mods"]]
    out = [(f.at(m["a"]), s.t[m["name_at"]].end, " ".join(["private", *mods, f"_{field_name}"]))]
    for i in range(d.a, d.b):
        if s.is_(i, field_name) and s.is_(i - 1, ".", "?.") and s.is_(i - 2, "this"):
            out.append((f.at(i), s.t[i].end, f"_{field_name}"))
    close = f.at(d.b - 1)
    out.append((close, close, f"\n  get {field_name}(): {kind} {{\n    return this._{field_name};\n  }}\n" + ("" if "readonly" in mods else f"\n  set {field_name}(value: {kind}) {{\n    this._{field_name} = value;\n  }}\n")))
    return out


def convert_type_interface(f: File, name: str) -> list[Edit]:
    """An alias of an object type as an interface (its properties only), or an interface as an alias of an object type."""
    s, d = f.s, need(f.s, name, "type", "interface")
    heads = "".join(m + " " for m in MODIFIER_ORDER if m in d.prefixes)
    if d.kind == "interface":
        body = s.until(d.name_at + 1, "{")
        types = s.span(d.name_at + 1, s.angles(d.name_at + 1))
        bases = [s.span(a, b) for i in range(d.name_at, body) if s.is_(i, "extends") for a, b in s.parts(i + 1, body)]
        text = f.text[f.at(body) : s.t[s.pair[body]].end]
        return [(f.at(d.a), f.end(d.b), f"{heads.replace('default ', '')}type {name}{types} = {''.join(b + ' & ' for b in bases)}{text};")]
    eq = s.angles(d.name_at + 1)
    if not s.is_(eq + 1, "{") or s.after(eq + 1) < d.b - s.is_(d.b - 1, ";"):
        raise Refused(f"type '{name}' is not an object literal type")
    members, j, end = [], eq + 2, s.pair[eq + 1]
    while j < end:
        if s.is_(j, ";", ","):
            j += 1
            continue
        k = s._line_end(j, end, ",")
        named = j + s.is_(j, "readonly")
        colon = s.after(named) + s.is_(s.after(named), "?")
        if s.is_(colon, ":"):
            members.append(f"  {s.span(j, k)};\n")
        j = max(k, j + 1)
    return [(f.at(d.a), f.end(d.b), f"{heads}interface {name}{s.span(d.name_at + 1, eq)} {{\n{''.join(members)}}}")]


def extract_interface(f: File, class_name: str, interface_name: str) -> list[Edit]:
    """An interface of the public members before the class, which implements it. Types not written down: ``unknown``."""
    s, d = f.s, need(f.s, class_name, "class")
    lines = []
    for m in class_members(s, d):
        if m["hidden"] or "static" in m["mods"] or m["name"] == "constructor":
            continue
        if m["kind"] == "property":
            lines.append(f"  {m['name']}{'?' if m['optional'] else ''}: {m['type'] or literal_type(m['value']) or 'unknown'};\n")
        elif m["kind"] == "method":
            params = ", ".join(f"{p['name']}: {p['type']}" for p in s.params(m["head"].p))
            lines.append(f"  {m['name']}({params}): {m['head'].returns or 'unknown'};\n")
    body = s.until(d.name_at + 1, "{")
    at = f.at(body)
    joined = f", {interface_name} " if any(s.is_(i, "implements") for i in range(d.name_at, body)) else f"implements {interface_name} "
    before = f.end(body) if joined.startswith(",") else at
    heads = "export " if "export" in d.prefixes else ""
    return [(f.at(d.a), f.at(d.a), f"{heads}interface {interface_name} {{\n{''.join(lines)}}}\n\n"), (before, at, joined)]


def composition(f: File, class_name: str) -> list[Edit]:
    """A delegate instead of a parent class, with forwarding methods if the parent is in the same file."""
    s, d = f.s, need(f.s, class_name, "class")
    body = s.until(d.name_at + 1, "{")
    ext = next((i for i in range(d.name_at, body) if s.is_(i, "extends")), None)
    if ext is None:
        raise Refused(f"class '{class_name}' does not extend anything")
    stop = next((i for i in range(ext, body) if s.is_(i, "implements")), body)
    parent = s.span(ext + 1, stop)
    own = {m["name"] for m in class_members(s, d)}
    delegate = f"_{parent[:1].lower()}{parent[1:]}".split("<")[0]
    forwards = []
    base = declaration(s, parent.split("<")[0])
    for m in class_members(s, base) if base and base.kind == "class" else []:
        if m["kind"] == "method" and "private" not in m["mods"] and m["name"] not in own and m["name"] != "constructor" and "static" not in m["mods"]:
            names = ", ".join(p["name"] for p in s.params(m["head"].p))
            is_async = "async" in m["mods"]
            returns = f": {m['head'].returns}" if m["head"].returns else ""
            forwards.append(f"\n  {'async ' if is_async else ''}{m['name']}({', '.join(parameter_texts(s, m['head'].p))}){returns} {{\n    return {'await ' if is_async else ''}this.{delegate}.{m['name']}({names});\n  }}\n")
    open_end, close = s.t[body].end, f.at(d.b - 1)
    out = [(f.at(ext), f.at(stop), ""), (open_end, open_end, f"\n  private {delegate} = new {parent}();\n")]
    for i in range(body, d.b):  # a call of the parent's constructor has nothing to call any more
        if s.is_(i, "super") and s.is_(i + 1, "("):
            stop = s.after(i + 1)
            out.append((f.at(i), f.end(stop + s.is_(stop, ";")), ""))
        elif s.is_(i, "super") and s.is_(i + 1, "."):
            out.append((f.at(i), s.t[i].end, f"this.{delegate}"))
    return [*out, (close, close, "".join(forwards))] if forwards else out


def cjs_to_esm(f: File) -> list[Edit]:
    """Top-level ``require`` declarations as imports, and assignments to ``exports`` at top level as exports."""
    s, out = f.s, []
    for d in declarations(s):
        k = s.after(d.name_at)
        plain = s.is_(k, "=") and s.is_(k + 1, "require") and s.is_(k + 2, "(") and s.string(k + 3) is not None and s.after(k + 2) == d.b - s.is_(d.b - 1, ";")
        if d.kind != "variable" or d.siblings > 1 or not plain:
            continue
        q = s.t[k + 3].text[0]
        new = Import(0, 0, s.string(k + 3), q)
        if s.is_(d.name_at, "{"):
            for a, b in s.parts(d.name_at + 1, s.pair[d.name_at]):
                new.named.append((s.name(a), s.name(a + 2) if s.is_(a + 1, ":") else s.name(a)))
        else:
            new.default = d.name
        out.append((f.at(d.a), f.end(d.b), new.text()))
    i = 0
    while i < s.n:
        j = i + 2 if s.is_(i, "module") and s.is_(i + 1, ".") else i
        if s.is_(j, "exports") and not s.is_(i - 1, "."):
            prop = s.name(j + 2) if s.is_(j + 1, ".") and s.is_(j + 3, "=") else None
            eq = j + 3 if prop else j + 1
            if s.is_(eq, "=") and (prop or j != i):
                stop = s._line_end(eq + 1, s.n)
                head = f"export const {prop} = " if prop else "export default "
                out.append((f.at(i), f.end(stop + s.is_(stop, ";")), f"{head}{s.span(eq + 1, stop)};"))
                i = stop
        i = s.after(i)
    return out


def replace_with_import(f: File, name: str, source: str) -> list[Edit]:
    """A local declaration replaced by an import; an exported function is refused, since others may use this copy."""
    d = need(f.s, name)
    if d.kind == "function" and "export" in d.prefixes:
        raise Refused(f"'{name}' is exported")
    return [removal(f, d), *added_import(f, source, [name])]


def extract_variable(f: File, start: int, end: int, name: str, kind: str = "const") -> list[Edit]:
    """The expression at characters ``start`` to ``end`` as a variable before its statement; equal token runs after it in
    the same block follow. Equal text in other files stays: the name is not in scope there."""
    s = f.s
    span = [i for i in range(s.n) if start <= s.t[i].start and s.t[i].end <= end]
    if not span or s.t[span[0]].start != start or s.t[span[-1]].end != end:
        raise Refused("no expression at position")
    a, b = span[0], span[-1] + 1
    block, scope_end = f.names.block(a)
    first, last = block + 1, min(scope_end, s.n)
    statement = next((x for x, y in s.each_statement(first, last) if x <= a < y), first)
    words = [t.text for t in s.t[a:b]]
    hits, i = [], statement
    while i + len(words) <= last:
        if [t.text for t in s.t[i : i + len(words)]] == words and not s.is_(i - 1, ".", "?.") and (i + len(words) >= s.n or not s.is_(i + len(words), "(") or len(words) > 1):
            hits.append(i)
            i += len(words)
        else:
            i += 1
    at = f.at(statement)
    indent = re.search(r"[ \t]*$", f.text[:at])[0]
    return [(at, at, f"{kind} {name} = {f.text[start:end]};\n{indent}")] + [(f.at(i), f.end(i + len(words)), name) for i in hits]


def extract_function(f: File, start: int, end: int, name: str) -> list[Edit]:
    """The statements at characters ``start`` to ``end`` as a function at the end of the file; names of enclosing
    functions that they use become its parameters, in order of the alphabet. A value that they return or set is not inferred."""
    s = f.s
    span = [i for i in range(s.n) if start <= s.t[i].start and s.t[i].end <= end]
    if not span:
        raise Refused("no statement at position")
    inside, params = set(span), set()
    for i in span:
        if s.t[i].kind == "id" and not f.names.is_key(i) and (own := f.names.owner(i)) and own[0] >= 0 and own[2] not in inside:
            params.add(s.t[i].text)
    args = ", ".join(sorted(params))
    text = f.text[s.t[span[0]].start : s.t[span[-1]].end]
    tail = "" if f.text.endswith("\n") or not f.text else "\n"
    return [(s.t[span[0]].start, s.t[span[-1]].end, f"{name}({args});"), (len(f.text), len(f.text), f"{tail}\nfunction {name}({args}) {{\n  {text}\n}}\n")]


def dead_declarations(f: File, names: list[str]) -> list[Edit]:
    """Top-level declarations of these names taken out; a whole statement once, if all of its declarators go."""
    found = [d for d in declarations(f.s) if d.name in names]
    out, whole = [], set()
    for d in found:
        if d.siblings > 1 and sum(x.a == d.a for x in found) == d.siblings:
            if d.a not in whole:
                whole.add(d.a)
                d.siblings = 1
                out.append(removal(f, d))
        else:
            out.append(removal(f, d))
    return out


# Rewrites of a symbol and of the files that import it


def renamed_uses(f: File, name: str, new: str) -> list[Edit]:
    return [(f.at(i), f.s.t[i].end, f"{name}: {new}" if f.names.shorthand(i) else new) for i in f.names.references(name)]


def rename_own(f: File, name: str, new: str) -> list[Edit]:
    """The declaration and its uses; ``export { name }`` becomes ``export { new }``."""
    d = need(f.s, name)
    if declaration(f.s, new):
        raise Refused(f"'{new}' exists already")
    return [(f.at(d.name_at), f.s.t[d.name_at].end, new), *renamed_uses(f, name, new)]


def rename_importer(f: File, name: str, new: str) -> list[Edit]:
    """Named imports and their uses; an import under another local name changes only there, a re-export keeps its name."""
    need(f.holder, name)
    if declaration(f.holder, new):
        raise Refused(f"'{new}' exists already")
    s, out = f.s, []
    for d in import_declarations(s):
        if d.source in f.sources and any(n == name for n, _ in d.named):
            local = next(x for n, x in d.named if n == name)
            d.named = [(new, new if x == name else x) if n == name else (n, x) for n, x in d.named]
            out.append(rendered(f, d))
            if local == name:
                out += [e for e in renamed_uses(f, name, new) if not f.at(d.a) <= e[0] < f.end(d.b)]
    for a in re_exported(f, name):
        out.append((f.at(a), s.t[a].end, new if s.is_(a + 1, "as") else f"{new} as {name}"))
    return out


def re_exported(f: File, name: str) -> list[int]:
    s, out = f.s, []
    for i in range(s.n):
        if s.is_(i, "export") and s.is_(o := i + 1 + s.is_(i + 1, "type"), "{") and s.is_(s.after(o), "from") and s.string(s.after(o) + 1) in f.sources:
            out += [a for a, _ in s.parts(o + 1, s.pair[o]) if s.name(a) == name]
    return out


def without_import(f: File, name: str) -> list[Edit]:
    if re_exported(f, name):
        raise Refused(f"'{name}' is exported again by {f.path}")
    return [e for source in sorted(f.sources) for e in removed_import(f, source, [name])]


def compound(value: str) -> bool:
    """Whether an operator stands outside of brackets."""
    v, k = Source(value), 0
    while k < v.n:
        if v.t[k].text in OPERATORS and v.t[k].kind in ("punct", "id") or v.is_(k, "=>", "await", "new", "typeof"):
            return True
        k = v.after(k)
    return False


def fitted(s: Source, i: int, j: int, value: str, is_type: bool = False) -> str:
    """``value`` for the tokens from ``i`` up to ``j``, in brackets where a neighbour would take part of it."""
    before, after = ("|", "&", "keyof"), ("[", "&", "|")
    if not is_type:
        before, after = (*OPERATORS[:-4], "!", "...", "await", "typeof"), (*OPERATORS[:-4], "?", ".", "?.", "[", "(")
    return f"({value})" if (s.is_(i - 1, *before) or s.is_(j, *after)) and compound(value) else value


def inlined(f: File, local: str, value: str, keep: list[tuple[int, int]], is_type: bool = False) -> list[Edit]:
    """``value`` for each use of ``local`` outside the ranges ``keep``."""
    out = []
    for i in f.names.references(local):
        if not any(a <= f.at(i) < b for a, b in keep):
            out.append((f.at(i), f.s.t[i].end, f"{local}: {value}" if f.names.shorthand(i) else fitted(f.s, i, i + 1, value, is_type)))
    return out


def inline_value(s: Source, name: str, kind: str) -> str:
    d = need(s, name, kind)
    if kind == "type":
        eq = s.angles(d.name_at + 1)
        return s.span(eq + 1, d.b - s.is_(d.b - 1, ";"))
    value = initial_value(s, d)
    if value is None:
        raise Refused("variable has no initializer")
    return value


def inline_own(kind: str) -> Callable:
    def own(f: File, name: str) -> list[Edit]:
        value = inline_value(f.s, name, kind)
        gone = removal(f, need(f.s, name, kind))
        return [gone, *inlined(f, name, value, [gone[:2]], kind == "type")]

    return own


def inline_importer(kind: str) -> Callable:
    def importer(f: File, name: str) -> list[Edit]:
        value, out = inline_value(f.holder, name, kind), without_import(f, name)
        for local in local_names(f.s, f.sources, name):
            out += inlined(f, local, value, [e[:2] for e in out], kind == "type")
        return out

    return importer


def inline_body(s: Source, name: str) -> tuple[str, list[str]]:
    d = need(s, name, "function")
    h = Head.of(s, d.name_at)
    value = single_return(s, h.body) if s.is_(h.body, "{") else None
    if not value:
        raise Refused("function must have a single return")
    return value, [p["name"] for p in s.params(h.p)]


def inlined_calls(f: File, local: str, value: str, params: list[str], keep: list[tuple[int, int]]) -> list[Edit]:
    s, out, done = f.s, [], -1
    for i in f.names.references(local):
        p = s.angles(i + 1)
        if s.is_(p, "(") and i > done and not any(a <= f.at(i) < b for a, b in keep):
            args = parameter_texts(s, p)
            swap = {q: (f"({args[n]})" if compound(args[n]) and compound(value) else args[n]) if n < len(args) else "undefined" for n, q in enumerate(params)}
            text = re.sub(r"\b(?:" + "|".join(map(re.escape, swap)) + r")\b", lambda m: swap[m[0]], value) if swap else value
            done = s.pair.get(p, p)  # calls within these arguments stay as they are
            out.append((f.at(i), s.t[done].end, fitted(s, i, done + 1, text)))
    return out


def inline_function_own(f: File, name: str) -> list[Edit]:
    """Calls replaced by the returned expression with arguments for parameters; a missing argument is ``undefined``."""
    value, params = inline_body(f.s, name)
    gone = removal(f, need(f.s, name, "function"))
    return [gone, *inlined_calls(f, name, value, params, [gone[:2]])]


def inline_function_importer(f: File, name: str) -> list[Edit]:
    (value, params), out = inline_body(f.holder, name), without_import(f, name)
    for local in local_names(f.s, f.sources, name):
        out += inlined_calls(f, local, value, params, [e[:2] for e in out])
    return out


def signature_calls(f: File, local: str, gone: list[int], added: list[str], inside: tuple[int, int] = (-1, -1)) -> list[Edit]:
    """Arguments of every call of ``local``, nested calls rewritten from the inside."""
    calls = [i for i in f.names.references(local) if f.s.is_(f.s.angles(i + 1), "(")]
    s = f.s

    def new_args(i: int) -> str:
        p = s.angles(i + 1)
        kept = [(a, b) for n, (a, b) in enumerate(s.parts(p + 1, s.pair.get(p, p))) if n not in gone]
        return ", ".join([rewritten(a, b) for a, b in kept] + added)

    def rewritten(a: int, b: int) -> str:
        text, base, inner = s.span(a, b), f.at(a), [i for i in calls if a <= i < b]
        edits, done = [], -1
        for i in inner:
            p = s.angles(i + 1)
            if i > done:
                done = s.pair.get(p, p)
                edits.append((s.t[p].end - base, f.at(done) - base, new_args(i)))
        return apply(text, edits)

    out, done = [], -1
    for i in calls:
        p = s.angles(i + 1)
        if i > done and not s.is_(i - 1, "function"):
            done = s.pair.get(p, p)
            out.append((s.t[p].end, f.at(done), new_args(i)))
    return out


def signature_change(s: Source, name: str, add, remove) -> tuple[list[int], list[str]]:
    d = need(s, name, "function")
    names = [p["name"] for p in s.params(Head.of(s, d.name_at).p)]
    return [i for i, n in enumerate(names) if n in remove], ["undefined" if v is None else v for _, _, v in add]


def change_signature_own(f: File, name: str, add=(), remove=()) -> list[Edit]:
    """Parameters added at the end (``(name, type, default)``) or removed, here and in calls."""
    gone, added = signature_change(f.s, name, add, remove)
    return parameter_edits(f, Head.of(f.s, need(f.s, name).name_at), add, remove) + signature_calls(f, name, gone, added)


def change_signature_importer(f: File, name: str, add=(), remove=()) -> list[Edit]:
    gone, added = signature_change(f.holder, name, add, remove)
    return [e for local in local_names(f.s, f.sources, name) for e in signature_calls(f, local, gone, added)]


def default_name(s: Source) -> str:
    for d in declarations(s):
        if "default" in d.prefixes:
            return d.name
    for i in range(s.n):
        if s.is_(i, "export") and s.is_(i + 1, "default") and s.name(i + 2) and (s.is_(i + 3, ";") or i + 3 >= s.n or s.line(i + 3) > s.line(i + 2)):
            return s.name(i + 2)
    raise Refused("no named default export")


def default_to_named_own(f: File) -> list[Edit]:
    """``export default`` of a named declaration or of a name as a named export."""
    name, s = default_name(f.s), f.s
    for d in declarations(s):
        if "default" in d.prefixes:
            at = next(i for i in range(d.a, d.word) if s.is_(i, "default"))
            return [(f.at(at), f.at(at + 1), "")]
    i = next(i for i in range(s.n) if s.is_(i, "export") and s.is_(i + 1, "default"))
    return [(f.at(i + 1), s.t[i + 2].end, f"{{ {name} }}")]


def default_to_named_importer(f: File) -> list[Edit]:
    name, out = default_name(f.holder), []
    for d in import_declarations(f.s):
        if d.source in f.sources and (d.default or any(n == "default" for n, _ in d.named)):
            d.named = ([(name, d.default)] if d.default else []) + [(name if n == "default" else n, x) for n, x in d.named]
            d.default = None
            out.append(rendered(f, d))
    return out + [(f.at(a), f.s.t[a].end, name if f.s.is_(a + 1, "as") else f"{name} as default") for a in re_exported(f, "default")]


def public_methods(s: Source, class_name: str) -> list[dict]:
    d = need(s, class_name, "class")
    return [m for m in class_members(s, d) if m["kind"] == "method" and "private" not in m["mods"] and m["name"] != "constructor"]


def class_to_functions_own(f: File, class_name: str) -> list[Edit]:
    """Public methods as functions; constructor and fields go. A class that another one here extends is refused."""
    s, d = f.s, need(f.s, class_name, "class")
    if any(s.is_(i, "extends") and s.is_(i + 1, class_name) for i in range(s.n)):
        raise Refused(f"class '{class_name}' is extended")
    heads = "export " if "export" in d.prefixes else ""
    texts = []
    for m in public_methods(s, class_name):
        h = m["head"]
        returns = f": {h.returns}" if h.returns else ""
        body = s.span(h.body, s.after(h.body)) if s.is_(h.body, "{") else "{}"
        texts.append(f"{heads}{'async ' if 'async' in m['mods'] else ''}function {m['name']}({', '.join(parameter_texts(s, h.p))}){returns} {body}")
    return [(f.at(d.a), f.end(d.b), "\n\n".join(texts))]


def class_to_functions_importer(f: File, class_name: str) -> list[Edit]:
    """The class's import becomes imports of its functions; ``new`` expressions are left to be changed by hand."""
    methods, out = [m["name"] for m in public_methods(f.holder, class_name)], []
    if any(f.s.is_(i, "extends") and f.s.is_(i + 1, *local_names(f.s, f.sources, class_name)) for i in range(f.s.n)):
        raise Refused(f"class '{class_name}' is extended in {f.path}")
    for d in import_declarations(f.s):
        if d.source in f.sources and any(n == class_name for n, _ in d.named):
            d.named = [x for x in d.named if x[0] != class_name] + [(m, m) for m in methods]
            out.append(rendered(f, d))
    return out


def move_own(f: File, name: str, to: str) -> list[Edit]:
    """The declaration and its comments leave; one that was not exported is imported back; unused imports go."""
    d = need(f.s, name)
    if d.siblings > 1:
        raise Refused(f"'{name}' shares its statement with others")
    out = [removal(f, d, comments=True)]
    if "export" in d.prefixes or not f.names.references(name):
        return out + unused_imports(f, (d.a, d.b))
    gone = unused_imports(f, (d.a, d.b))
    new = added_import(f, specifier(f.path, to), [name])
    return out + merged(gone, new)


def merged(gone: list[Edit], new: list[Edit]) -> list[Edit]:
    """Two lists of edits of imports, without meeting ones: an insertion moves to the edge of a removal."""
    for a, b, text in new:
        gone = [g for g in gone if a == b or g[1] <= a or b <= g[0]]
        gone.append((a, b, text))
    return gone


def move_target(f: File, name: str, to: str) -> list[Edit]:
    """The file that receives the declaration: at its end and exported, unless it declares the name already."""
    d = need(f.holder, name)
    if d.siblings > 1:
        raise Refused(f"'{name}' shares its statement with others")
    out = []
    for source in sorted(f.sources):
        out += removed_import(f, source, [name]) if any(i.source == source and any(n == name for n, _ in i.named) for i in import_declarations(f.s)) else []
    if declaration(f.s, name):
        return out
    text = f.holder.span(d.a, d.b)
    if "export" not in d.prefixes:
        at = f.holder.t[d.word - len(d.prefixes)].start - f.holder.t[d.a].start
        text = text[:at] + "export " + text[at:]
    comments = leading_comments(f.holder_text or "", f.holder.t[d.a].start)
    tail = "" if f.text.endswith("\n") or not f.text else "\n"
    return out + [(len(f.text), len(f.text), f"{tail}{comments}{text}\n")]


def move_importer(f: File, name: str, to: str) -> list[Edit]:
    """Importers take the name from its new file, under the local name that they use."""
    if f.path == to:
        return move_target(f, name, to)
    need(f.holder, name)
    out = []
    for d in import_declarations(f.s):
        if d.source in f.sources and (moved := [x for x in d.named if x[0] == name]):
            d.named = [x for x in d.named if x[0] != name]
            line = Import(0, 0, specifier(f.path, to), d.quote, named=moved, type_only=d.type_only).text()
            a, b, text = rendered(f, d)
            out.append((a, b, f"{text}\n{line}" if text else line + f.text[f.end(d.b) : b]))
    for a in re_exported(f, name):
        raise Refused(f"'{name}' is exported again by {f.path}")
    return out


def safe_delete_own(f: File, name: str) -> list[Edit]:
    d = need(f.s, name)
    if n := len([i for i in f.names.references(name) if not d.a <= i < d.b]):
        raise Refused(f"symbol '{name}' has {n} references")
    return [removal(f, d)]


def safe_delete_importer(f: File, name: str) -> list[Edit]:
    if local_names(f.s, f.sources, name) or re_exported(f, name):
        raise Refused(f"symbol '{name}' has references in {f.path}")
    return []


@dataclass
class Rewrite:
    own: Callable
    importer: Callable | None = None


REWRITES = {
    "rename": Rewrite(rename_own, rename_importer),
    "move": Rewrite(move_own, move_importer),
    "extract_variable": Rewrite(extract_variable),
    "extract_function": Rewrite(extract_function),
    "extract_interface": Rewrite(extract_interface),
    "inline_variable": Rewrite(inline_own("variable"), inline_importer("variable")),
    "inline_type": Rewrite(inline_own("type"), inline_importer("type")),
    "inline_function": Rewrite(inline_function_own, inline_function_importer),
    "change_signature": Rewrite(change_signature_own, change_signature_importer),
    "to_arrow": Rewrite(to_arrow),
    "to_async": Rewrite(to_async),
    "safe_delete": Rewrite(safe_delete_own, safe_delete_importer),
    "convert_type": Rewrite(convert_type_interface),
    "modify": Rewrite(modify),
    "encapsulate": Rewrite(encapsulate),
    "class_to_functions": Rewrite(class_to_functions_own, class_to_functions_importer),
    "composition": Rewrite(composition),
    "cjs_to_esm": Rewrite(cjs_to_esm),
    "default_to_named": Rewrite(default_to_named_own, default_to_named_importer),
    "replace_with_import": Rewrite(replace_with_import),
}


def planned(f: File, operation: str, **args) -> tuple[str | None, str | None]:
    """The new text of a file (or null, if it stays) and why the rewrite is refused."""
    r = REWRITES[operation]
    try:
        edits = r.own(f, **args) if f.own else r.importer(f, **args)
        new = apply(f.text, edits)
        return (new if new != f.text else None), None
    except Refused as e:
        return None, str(e)
    except (IndexError, KeyError, RecursionError, StopIteration) as e:
        return None, f"{type(e).__name__}: {e}"
