"""Data-flow graphs of top-level functions, as node and edge rows.

Nodes come in source order: parameters, definitions, assignments to plain names, returns, uses within them, and calls
within initial values. The last definition before a place counts, whatever the control flow; a definition is in force in
its own initial value. Edges are ``def-use`` and, for arguments that are plain names, ``call-arg``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.sources.batches import rows_by_text
from lithoscope.sources.names import import_declarations
from lithoscope.sources.extract import NOT_CALLED, Source

NODE = "id:int,name:string,type:string,line:int,source:string,expression:string"
EDGE = "src:int,dst:int,type:string,label:string"
FLOWS = f"function_name string, nodes array<struct<{NODE}>>, edges array<struct<{EDGE}>>"
#: Characters of an expression that are shown.
EXPRESSION_CHARS = 60
PLAIN_ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=")
DECLARE = ("const", "let", "var")


class DataFlow:
    """The graph of the function whose parameters are at ``head`` and whose block is at ``body``."""

    def __init__(self, source: Source, name: str, head: int, body: int, imported: dict[str, str]):
        self.s, self.name, self.imported = source, name, imported
        self.nodes, self.edges, self.current = [], [], {}
        for a, b in source.parts(head + 1, source.pair.get(head, head)):
            a += source.is_(a, "...")
            shown = source.name(a) or source.span(a, source.after(a))
            self.current[shown] = self.new(shown, "parameter", a)
        self.walk(body + 1, source.pair.get(body, body))

    def new(self, name: str, kind: str, at: int, expression: str | None = None, source: str | None = None) -> int:
        shown = expression[:EXPRESSION_CHARS] if expression else None
        self.nodes.append({"id": len(self.nodes), "name": name, "type": kind, "line": self.s.line(min(at, self.s.n - 1)), "source": source, "expression": shown})
        return len(self.nodes) - 1

    def value_end(self, i: int, end: int) -> int:
        return self.s._line_end(i, end, ",", ")", "]", "}")

    def walk(self, i: int, end: int) -> None:
        s = self.s
        pending: dict[int, int] = {}  # place of a later declarator -> end of its statement
        while i < end:
            if s.is_(i, *DECLARE) and not s.is_(i - 1, ".") and not s.is_(i + 1, "enum"):
                pending[i + 1] = end
            elif i in pending:
                self.declarator(i, pending.pop(i), pending)
            elif s.name(i) and s.is_(i + 1, *PLAIN_ASSIGNMENTS) and not s.is_(i - 1, ".", "?.") and not self.defined_here(i) and not self.attribute(i):
                stop = self.value_end(i + 2, end)
                self.current[s.name(i)] = node = self.new(s.name(i), "assignment", i, s.span(i + 2, stop))
                self.uses(i + 2, stop)
            elif s.is_(i, "return") and not s.is_(i - 1, "."):
                same_line = i + 1 < end and s.line(i + 1) == s.line(i)
                stop = self.value_end(i + 1, end) if same_line else i + 1
                self.new("return", "return", i, s.span(i + 1, stop))
                self.uses(i + 1, stop)
            i += 1

    def defined_here(self, i: int) -> bool:
        """Whether the name at ``i`` is a default of a pattern or parameter rather than an assignment's target."""
        return self.s.is_(i + 1, "=") and (self.s.is_(i - 1, ",", "...") or self.s.is_(i - 1, "{", "[") and self.s.is_(i - 2, *DECLARE, "(", ","))

    def attribute(self, i: int) -> bool:
        """Whether the name at ``i`` is an attribute of a JSX tag: ``<tag name={...}`` or after another attribute's value."""
        s = self.s
        return s.is_(i + 1, "=") and s.is_(i + 2, "{") and (s.is_(i - 2, "<") or s.is_(i - 1, "}") and s.line(i - 1) == s.line(i))

    def declarator(self, i: int, end: int, pending: dict[int, int]) -> None:
        s = self.s
        k = s.after(i)
        shown = s.span(i, k)
        k += s.is_(k, "!")
        if s.is_(k, ":"):
            k = s._line_end(k + 1, end, "=", ",", ")")
        stop = self.value_end(k + 1, end) if s.is_(k, "=") else k
        node = self.new(shown, "definition", i, s.span(k + 1, stop) if s.is_(k, "=") else None)
        self.current[shown] = node
        if s.is_(k, "="):
            self.uses(k + 1, stop)
            self.calls(k + 1, stop)
        if s.is_(stop, ","):
            pending[stop + 1] = end

    def uses(self, a: int, b: int) -> None:
        for i in range(a, b):
            if (name := self.s.name(i)) in self.current:
                before = self.current[name]
                self.edges.append({"src": before, "dst": self.new(name, "usage", i), "type": "def-use", "label": None})

    def calls(self, a: int, b: int) -> None:
        s, found = self.s, []
        close = {c: o for o, c in s.pair.items() if a <= o < b}
        for i in range(a, b):
            if s.is_(i, "(") and s.span(i, i + 1).startswith("(") and (s.name(i - 1) and s.name(i - 1) not in NOT_CALLED or s.is_(i - 1, ")", "]")) and i > a:
                j = i - 1
                while True:  # back over a chain of members, calls and indexes
                    j = close.get(j, j)
                    if s.is_(j, "(", "[") and j > a and (s.name(j - 1) and s.name(j - 1) not in NOT_CALLED or s.is_(j - 1, ")", "]")):
                        j -= 1
                    elif s.is_(j - 1, ".", "?.") and j - 2 >= a:
                        j -= 2
                    else:
                        break
                if not s.is_(j - 1, "new", "function"):
                    found.append((j, -i))
        for j, i in sorted(found):
            callee = s.span(j, -i)
            node = self.new(callee, "call", j, s.span(j, s.after(-i)), self.imported.get(callee))
            for x, y in s.parts(-i + 1, s.pair.get(-i, -i)):
                if y == x + 1 and s.name(x) in self.current:
                    self.edges.append({"src": self.current[s.name(x)], "dst": node, "type": "call-arg", "label": s.name(x)})


def imported_names(s: Source) -> dict[str, str]:
    """Local names of imports with the specifier that each comes from."""
    return {local: d.source for d in import_declarations(s) for local in d.locals()}


def data_flows(text: str) -> list[DataFlow]:
    """Graphs of the function declarations at top level, in order."""
    s, out, i = Source(text), [], 0
    imported = imported_names(s)
    while i < s.n:
        k = i + 1 + s.is_(i + 1, "*")
        if s.is_(i, "function") and s.name(k) and s.is_(p := s.angles(k + 1), "("):
            _, body = s.return_type(s.after(p))
            if s.is_(body, "{"):
                out.append(DataFlow(s, s.name(k), p, body, imported))
                i = body
        i = s.after(i)
    return out


def data_flow(files: DataFrame) -> DataFrame:
    """``file_path, function_name, nodes, edges`` of ``files(path, text)``; a file that can't be read has none."""

    def read(text):
        try:
            return [{"function_name": f.name, "nodes": f.nodes, "edges": f.edges} for f in data_flows(text)]
        except (IndexError, KeyError, RecursionError):
            return []

    return rows_by_text(files, "file_path", FLOWS, read)


def nodes(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """Node rows; ``source_file`` is the file that a called import resolves to by ``edges(src, source, dst)``."""
    each = flows.select("file_path", "function_name", F.explode("nodes").alias("n")).select("file_path", "function_name", "n.*")
    resolved = edges.where(F.col("dst").isNotNull()).select(F.col("src").alias("file_path"), "source", F.col("dst").alias("source_file")).distinct()
    return each.join(resolved, ["file_path", "source"], "left").drop("source")


def flow_edges(flows: DataFrame) -> DataFrame:
    return flows.select("file_path", "function_name", F.explode("edges").alias("e")).select("file_path", "function_name", "e.*")
