"""A debugging aid: the nested outline of a C source, each part with its byte range and its first and last place.

Parts are directives, declarations and definitions at the top, and below them bracketed groups and statements;
leaves are tokens. One line a part: indentation, kind, [first byte-after last], (Lrow:column-Lrow:column), rows and columns from 1.
"""

from __future__ import annotations

from collections.abc import Iterator

from .c_facts import PAIRS
from .c_tokens import _DIRECTIVE, _TOKEN

GROUPS = {"(": "parentheses", "[": "brackets", "{": "block"}
LEAVES = {"id": "identifier", "num": "number", "str": "string", "chr": "character", "op": "operator"}


def _pieces(source: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) of directives and tokens, in characters."""
    at, fresh = 0, True
    while at < len(source):
        if fresh and (m := _DIRECTIVE.match(source, at)):
            start = at + len(m[0]) - len(m[0].lstrip(" \t"))
            yield "directive", m[0].strip(), start, m.end()
            at, fresh = m.end(), False
            continue
        m = _TOKEN.match(source, at)
        kind = m.lastgroup
        if kind == "line":
            fresh = True
        elif kind not in ("space", "comment"):
            fresh = False
            yield kind, m[0], at, m.end()
        at = m.end()


class _Part:
    def __init__(self, kind: str, start: int) -> None:
        self.kind, self.start, self.end, self.inner = kind, start, start, []


def _tree(source: str) -> _Part:
    """Brackets nest; at the top and in blocks, parts end with a semicolon or a closing brace."""
    root = _Part("source", 0)
    open_: list[_Part] = [root]
    closers: list[str] = []

    def within(start: int) -> _Part:
        holder = open_[-1]
        if holder.kind in ("source", "block"):
            part = _Part("declaration" if holder is root else "statement", start)
            holder.inner.append(part)
            open_.append(part)
        return open_[-1]

    def finish(end: int) -> None:
        if open_[-1].kind in ("declaration", "statement"):
            part = open_.pop()
            part.end = end
            if part.kind == "declaration" and any(x.kind == "block" for x in part.inner[-1:]) and any(x.kind == "parentheses" for x in part.inner):
                part.kind = "definition"

    for kind, text, start, end in _pieces(source):
        if kind == "directive":
            leaf = _Part("directive", start)
            leaf.end = end
            open_[-1].inner.append(leaf)
        elif kind == "op" and text in PAIRS:
            group = _Part(GROUPS[text], start)
            within(start).inner.append(group)
            open_.append(group)
            closers.append(PAIRS[text])
        elif kind == "op" and closers and text == closers[-1]:
            finish(start)
            group = open_.pop()
            group.end = end
            closers.pop()
            if text == "}" and source[end:].lstrip()[:1] not in (";", ",", "=") and open_[-1].kind in ("declaration", "statement"):
                finish(end)
        else:
            leaf = _Part("error" if kind in ("open", "bad") else LEAVES[kind], start)
            leaf.end = end
            within(start).inner.append(leaf)
            if text == ";" and open_[-1].kind in ("declaration", "statement"):
                finish(end)
    while len(open_) > 1:
        open_.pop().end = len(source)
    root.end = len(source)
    return root


def outline(data: bytes) -> Iterator[str]:
    source = data.decode("utf-8", "replace")
    rows = [0]
    for i, c in enumerate(source):
        if c == "\n":
            rows.append(i + 1)
    bytes_at, total = [0], 0
    for c in source:
        total += len(c.encode("utf-8", "replace"))
        bytes_at.append(total)

    def place(at: int) -> str:
        from bisect import bisect_right

        row = bisect_right(rows, at) - 1
        return f"L{row + 1}:{bytes_at[at] - bytes_at[rows[row]] + 1}"

    stack = [(_tree(source), 0)]
    while stack:
        part, depth = stack.pop()
        yield f"{'  ' * depth}{part.kind} [{bytes_at[part.start]}-{bytes_at[part.end]}] ({place(part.start)}-{place(part.end)})"
        stack.extend((x, depth + 1) for x in reversed(part.inner))
