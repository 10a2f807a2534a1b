"""A tolerant lexer of JavaScript and TypeScript: one pattern for what is no nested template, a small loop for the rest.

It never fails: what it can't place becomes punctuation. A slash starts a regular expression only where an operand can
stand. Template literals give a token for themselves and the tokens of their expressions in brackets.
"""

from __future__ import annotations

import re
from typing import NamedTuple

TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/|^\#![^\n]*)
      |(?P<id>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*|\#[A-Za-z_$][\w$]*)
      |(?P<num>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
      |(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')
      |(?P<punct>=>|\.\.\.|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||===|!==|==|!=|<=|>=|\+\+|--|\*\*=|\*\*|[+\-*%&|^]=|<<|[^\s])""",
    re.X | re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
BEFORE_OPERAND = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


def lex(text: str, start: int = 0, stop: str | None = None) -> tuple[list[Token], int]:
    """Tokens from ``start`` up to an unmatched ``stop`` or the end, and where reading ended."""
    out: list[Token] = []
    at, depth = start, 0
    while at < len(text):
        c = text[at]
        if c == "`":
            inner, end = _template(text, at)
            out.append(Token("template", text[at:end], at, end))
            out.extend(inner)
            at = end
            continue
        if c == "/" and text[at : at + 2] not in ("//", "/*"):
            last = out[-1] if out else None
            operand = last is None or (last.kind == "punct" and last.text not in (")", "]", "}")) or (last.kind == "id" and last.text in BEFORE_OPERAND)
            if operand and (m := REGEX.match(text, at)):
                out.append(Token("regex", m[0], at, m.end()))
                at = m.end()
                continue
        m = TOKEN.match(text, at)
        if m.lastgroup == "space":
            at = m.end()
            continue
        if stop and m.lastgroup == "punct":
            if m[0] == "{":
                depth += 1
            elif m[0] == "}":
                if not depth:
                    return out, m.end()
                depth -= 1
        out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    return out, at


def _template(text: str, at: int) -> tuple[list[Token], int]:
    """Tokens of the expressions of the template at ``at``, each in round brackets, and its end."""
    out, at = [], at + 1
    while at < len(text):
        if text[at] == "\\":
            at += 2
        elif text[at] == "`":
            return out, at + 1
        elif text.startswith("${", at):
            inner, end = lex(text, at + 2, "}")
            out += [Token("punct", "(", at, at), *inner, Token("punct", ")", end, end)]
            at = end
        else:
            at += 1
    return out, len(text)
