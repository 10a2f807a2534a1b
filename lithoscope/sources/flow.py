"""Control-flow graphs of top-level functions, as block rows.

Block 0 is the entry and block 1 the exit. ``break``, ``continue`` and ``throw`` make no edge of their own; cases of a
switch neither fall through nor have an implicit default; a catch is entered from the head of its try; statements after a
return are left out; a switch without cases ends the flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lithoscope.sources.batches import rows_by_text
from lithoscope.sources.extract import NOT_CALLED, Source

BLOCKS = (
    "function_name string, id int, type string, label string, statements array<string>, calls array<string>, "
    "successors array<int>, predecessors array<int>, start_line int, end_line int"
)
#: Characters of a statement's and a label's text that are shown.
STATEMENT_CHARS, LABEL_CHARS = 80, 30


class Flow:
    """The graph of one function whose block is at ``body``."""

    def __init__(self, source: Source, name: str, body: int):
        self.s, self.name, self.blocks = source, name, []
        self.new("entry", "entry", body), self.new("exit", "exit", body)
        start = self.new("body", "body", body)
        self.edge(0, start)
        self.edge(self.walk(body + 1, source.pair.get(body, body), start), 1)

    def new(self, kind: str, label: str, at: int) -> int:
        line = self.s.line(min(at, self.s.n - 1))
        self.blocks.append({"id": len(self.blocks), "type": kind, "label": label[:LABEL_CHARS], "statements": [], "calls": [], "successors": [], "predecessors": [], "start_line": line, "end_line": line})
        return len(self.blocks) - 1

    def edge(self, a: int | None, b: int) -> None:
        if a is not None and b not in self.blocks[a]["successors"]:
            self.blocks[a]["successors"].append(b)
            self.blocks[b]["predecessors"].append(a)

    def note(self, block: int, a: int, b: int, text: bool = True) -> None:
        """Statement text and calls of the tokens from ``a`` to ``b``."""
        s, own = self.s, self.blocks[block]
        if text:
            own["statements"].append(s.span(a, b)[:STATEMENT_CHARS])
        for i in range(a, b):
            if s.is_(i, "(") and (f := s.name(i - 1)) and f not in NOT_CALLED and i - 1 >= a:
                own["calls"].append(f"{s.name(i - 3)}.{f}" if s.is_(i - 2, ".", "?.") and s.name(i - 3) else f)
        own["end_line"] = max(own["end_line"], s.line(max(a, b - 1)))

    def walk(self, i: int, end: int, at: int | None) -> int | None:
        while i < end and at is not None:
            i, at = self.statement(i, end, at)
        return at

    def joined(self, ends: list[int | None], label: str, where: int) -> int | None:
        ends = [e for e in ends if e is not None]
        if not ends:
            return None
        to = self.new("body", label, where)
        for e in ends:
            self.edge(e, to)
        return to

    def branch(self, i: int, end: int, kind: str, label: str, head: int) -> tuple[int, int | None]:
        """A statement or block in a new block after ``head``."""
        block = self.new(kind, label, i)
        self.edge(head, block)
        return self.statement(i, end, block)

    def statement(self, i: int, end: int, at: int) -> tuple[int, int | None]:
        s = self.s
        if s.is_(i, ";"):
            return i + 1, at
        if s.is_(i, "{"):
            return s.after(i), self.walk(i + 1, s.pair.get(i, end), at)
        if s.is_(i, "if") and s.is_(i + 1, "("):
            body = s.after(i + 1)
            head = self.new("branch", s.span(i, body), i)
            self.edge(at, head)
            self.note(head, i, body)
            then, a = self.branch(body, end, "body", "then", head)
            b = head
            if s.is_(then, "else"):
                then, b = self.branch(then + 1, end, "body", "else", head)
            return then, self.joined([a, b], "merge", then)
        if s.is_(i, "for", "while") and (p := i + 1 + s.is_(i + 1, "await")) and s.is_(p, "("):
            body = s.after(p)
            head = self.new("loop", s.span(i, body), i)
            self.edge(at, head)
            self.note(head, i, body)
            then, a = self.branch(body, end, "body", "loop body", head)
            self.edge(a, head)
            return then, self.joined([head], "after loop", then)
        if s.is_(i, "do"):
            head = self.new("loop", "do", i)
            self.edge(at, head)
            then, a = self.branch(i + 1, end, "body", "loop body", head)
            if s.is_(then, "while"):
                stop = s.after(then + 1)
                self.note(head, then, stop)
                then = stop + s.is_(stop, ";")
            self.edge(a, head)
            return then, self.joined([head], "after loop", then)
        if s.is_(i, "try") and s.is_(i + 1, "{"):
            head = self.new("try", "try", i)
            self.edge(at, head)
            then, ends = s.after(i + 1), [self.walk(i + 2, s.pair.get(i + 1, end), head)]
            if s.is_(then, "catch"):
                p = then + 1
                p = s.after(p) if s.is_(p, "(") else p
                then, a = self.branch(p, end, "catch", s.span(then, p), head)
                ends.append(a)
            if s.is_(then, "finally"):
                last = self.new("finally", "finally", then)
                for e in ends:
                    self.edge(e, last)
                then, a = self.statement(then + 1, end, last)
                ends = [a]
            return then, self.joined(ends, "after try", then)
        if s.is_(i, "switch") and s.is_(i + 1, "("):
            body = s.after(i + 1)
            head = self.new("switch", s.span(i, body), i)
            self.edge(at, head)
            self.note(head, i, body)
            stop, ends, j = s.pair.get(body, end), [], body + 1
            while j < stop:
                colon = s.until(j, ":", end=stop)
                case = self.new("case", s.span(j, colon), j)
                self.edge(head, case)
                a, j = case, colon + 1
                while j < stop and not s.is_(j, "case", "default"):
                    if a is None:
                        j = s.after(j)
                    else:
                        j, a = self.statement(j, stop, a)
                ends.append(a)
            return s.after(body), self.joined(ends, "after switch", stop)
        if s.is_(i, "function", "class") or s.is_(i, "async") and s.is_(i + 1, "function"):
            stop = s.after(s.until(i + 1, "{", end=end))
        else:
            stop = next((b for _, b in s.each_statement(i, end)), end)
        stop = max(stop, i + 1)
        self.note(at, i, stop - s.is_(stop - 1, ";"))
        if s.is_(i, "return"):
            self.edge(at, 1)
            return stop, None
        return stop, at


def flows(text: str) -> list[Flow]:
    """Graphs of the function declarations at top level, in order."""
    s, out, i = Source(text), [], 0
    while i < s.n:
        k = i + 1 + s.is_(i + 1, "*")
        if s.is_(i, "function") and s.name(k) and s.is_(p := s.angles(k + 1), "("):
            _, body = s.return_type(s.after(p))
            if s.is_(body, "{"):
                out.append(Flow(s, s.name(k), body))
                i = body
        i = s.after(i)
    return out


def control_flow(files: DataFrame) -> DataFrame:
    """Block rows of ``files(path, text)``; a file that can't be read has none."""

    def read(text):
        try:
            return [{"function_name": f.name} | x for f in flows(text) for x in f.blocks]
        except (IndexError, KeyError, RecursionError):
            return []

    return rows_by_text(files, "file_path", BLOCKS, read)
