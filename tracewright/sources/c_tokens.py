"""A lexer for C: comments, literals, line splices and preprocessor lines go; includes are kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>[ \t\f\v\r]+|\\\r?\n)|(?P<line>\n)|(?P<comment>//(?:\\\r?\n|[^\n])*|/\*.*?\*/)|(?P<open>/\*)"""
    r"""|(?P<str>(?:u8|[uUL])?"(?:\\.|[^"\\\n])*")|(?P<chr>[uUL]?'(?:\\.|[^'\\\n])*')|(?P<bad>["'])"""
    r"""|(?P<id>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<num>\.?[0-9](?:[eEpP][+-]|[A-Za-z0-9_.'])*)"""
    r"""|(?P<op>->|\+\+|--|<<=|>>=|<<|>>|<=|>=|==|!=|&&|\|\||\.\.\.|[-+*/%&|^]=|[^\s])""",
    re.S,
)
#: Lines that each hold a call of a plain name over plain names and whole numbers, and nothing else.
_CALL = r"[ \t]*[A-Za-z_$][A-Za-z0-9_$]*\((?:(?:[0-9]+|[A-Za-z_$][A-Za-z0-9_$]*)(?:,[ \t]*(?:[0-9]+|[A-Za-z_$][A-Za-z0-9_$]*))*)?\);\n"
_OR_RUN = re.compile(f"(?P<run>(?:{_CALL}){{1,64}})|" + _TOKEN.pattern, re.S)
_DIRECTIVE = re.compile(r"[ \t]*#(?:\\\r?\n|/\*.*?\*/|[^\n])*", re.S)
_INCLUDE = re.compile(r"""[ \t]*#[ \t]*include[ \t]*(?:"([^"\n]+)"|<([^>\n]+)>)""")


@dataclass(slots=True)
class Token:
    kind: str
    text: str
    line: int


@dataclass(slots=True)
class Scan:
    tokens: list[Token]
    #: (target, is_system, line)
    includes: list[tuple[str, bool, int]]
    #: An unterminated comment or literal.
    broken: bool


def tokens(source: str, found: Scan, runs: bool = False, line: int = 1) -> Iterator[Token]:
    """Tokens of a source, one at a time; includes and broken are told in found. Every arm of a conditional is kept, as the preprocessor does not run.

    runs: lines of plain calls come together as one token of kind run, which `tokens` of its text takes apart. line: that of the source's begin.
    """
    pattern = _OR_RUN if runs else _TOKEN
    fresh, last, step = True, None, pattern.scanner(source).match
    while m := step():
        kind, text, last = m.lastgroup, m[0], m
        if kind == "line":
            line, fresh = line + 1, True
        elif kind in ("space", "comment"):
            if len(text) > 1:
                line += text.count("\n")
        elif fresh and text == "#":
            last = m = _DIRECTIVE.match(source, m.start())
            if include := _INCLUDE.match(m[0]):
                found.includes.append((include[1] or include[2], include[1] is None, line))
            line, fresh = line + m[0].count("\n"), False
            step = pattern.scanner(source, m.end()).match
        elif kind == "run":
            yield Token(kind, text, line)
            line, fresh = line + text.count("\n"), True
        elif kind == "open":
            found.broken = True
            return
        elif kind == "bad":
            found.broken, fresh = True, False
        else:
            fresh = False
            yield Token(kind, text, line)
            if kind in ("str", "chr"):
                line += text.count("\n")
    if last and last.end() < len(source) or source and not last:  # a space that C has not
        found.broken = True


def scan(source: str) -> Scan:
    """All tokens of a source."""
    found = Scan([], [], False)
    found.tokens.extend(tokens(source, found))
    return found
