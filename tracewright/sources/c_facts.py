"""Facts of one C source, by bracket matching over tokens.

Recognised: function definitions and prototypes whose name stands right before its parameters and
behind one `*` at most; calls of plain names inside functions; named types with bodies; typedefs of
plain names; names in type position inside functions. A source is a syntax error as a whole if brackets
are unbalanced, a literal or comment does not end, a sign is no part of C, an initialiser is empty, or a
statement or the last declaration lacks its semicolon.

A source is read in pieces that end between external declarations, so that memory holds the tokens of one
piece, or of the longest external declaration, and not those of the whole source. Lines of plain calls that stand as
statements right in a function's body are one token, as a generated function may have millions of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from .c_tokens import Scan, Token, scan, tokens

#: Words that are never names, and names that the language family treats as built in.
KEYWORDS = set("auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local __attribute__ __attribute __asm__ asm __asm __extension__ __inline __inline__ __restrict __volatile__ __declspec offsetof alignof typeof __typeof__ defined".split())
PRIMITIVE = set("void char short int long float double signed unsigned _Bool bool _Complex size_t ssize_t ptrdiff_t intptr_t uintptr_t charptr_t nullptr_t max_align_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t char8_t char16_t char32_t char64_t".split())
TAGS = {"struct": "Struct", "union": "Union", "enum": "Enum"}
QUALIFIERS = {"const", "volatile", "restrict", "__restrict", "register", "static", "extern", "inline", "__inline", "__inline__", "auto", "_Noreturn", "_Thread_local", "_Atomic", "__extension__", "signed", "unsigned"}
PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Tokens of a piece, at least, where a source has more.
PIECE = 20_000


@dataclass
class Facts:
    definitions: list[tuple[str, int, bool]] = field(default_factory=list)
    declarations: list[tuple[str, int]] = field(default_factory=list)
    calls: list[tuple[str, str, int]] = field(default_factory=list)
    includes: list[tuple[str, bool, int]] = field(default_factory=list)
    types: list[tuple[str, int, str]] = field(default_factory=list)
    type_uses: list[tuple[str, str, int]] = field(default_factory=list)


class _Broken(Exception):
    pass


def _partners(tokens: list[Token]) -> dict[int, int]:
    """For every opening bracket its closing one."""
    out, open_ = {}, []
    for i, t in enumerate(tokens):
        if t.kind == "op":
            if t.text in PAIRS:
                open_.append(i)
            elif t.text in ")]}":
                if not open_ or PAIRS[tokens[open_[-1]].text] != t.text:
                    raise _Broken
                out[open_.pop()] = i
    if open_:
        raise _Broken
    return out


#: Signs that no C token begins with, once directives and literals are gone.
STRAY = set("@`\\#")
#: What may stand before the brace of a block of statements, and keywords whose brackets are no statement's head.
BEFORE_BLOCK, NO_HEAD = {";", "{", "}", ":"}, {"return", "sizeof", "case", "_Alignof", "alignof", "typeof", "__typeof__"}


def _check(tokens: list[Token], partner: dict[int, int], opened: dict[int, int]) -> None:
    """Raise _Broken for a stray sign, an empty initialiser, or a statement or declaration without its semicolon."""
    text = lambda i: ("" if tokens[i].kind not in ("op", "id", "run") else ";" if tokens[i].kind == "run" else tokens[i].text) if 0 <= i < len(tokens) else ""
    blocks: set[int] = set()
    around: list[int] = []  # the braces that are open
    for i, t in enumerate(tokens):
        if t.kind != "op":
            continue
        if t.text == "}":
            around.pop()
        if t.text in STRAY:
            raise _Broken
        if t.text == "=" and text(i + 1) in (";", ",", ")", "}", "]", "="):
            raise _Broken
        if t.text == "{":
            before = text(i - 1)
            if before == ")":
                head = opened[i - 1] - 1
                if head >= 0 and tokens[head].kind == "id" and tokens[head].text not in NO_HEAD or text(head) == ")":
                    blocks.add(i)
            elif before in ("else", "do") or (before in BEFORE_BLOCK and around and around[-1] in blocks):
                blocks.add(i)
            around.append(i)
    for o in blocks:
        last = partner[o] - 1
        if last > o and text(last) not in (";", "}", ":"):
            raise _Broken
    depth, open_ = 0, False
    for t in tokens:
        if t.kind == "op" and t.text in "([{":
            depth += 1
        elif t.kind == "op" and t.text in ")]}":
            depth -= 1
        if not depth:
            open_ = not (t.kind == "op" and t.text in (";", "}"))
    if open_:
        raise _Broken


class _Reader:
    def __init__(self, tokens: list[Token], facts: Facts) -> None:
        self.t = tokens
        self.partner = _partners(tokens)
        self.opened = {c: o for o, c in self.partner.items()}
        _check(tokens, self.partner, self.opened)
        #: Names of prototypes inside bodies.
        self.declared: set[int] = set()
        self.facts = facts

    # -- small tests -------------------------------------------------------
    def is_(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind != "str" and self.t[i].text == text

    def name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id" and self.t[i].text not in KEYWORDS and self.t[i].text not in PRIMITIVE

    def skip(self, i: int) -> int:
        """The place after token i, or after its closing bracket."""
        return self.partner.get(i, i) + 1

    # -- units -------------------------------------------------------------
    def unit(self, at: int, end: int, last: bool = True) -> int:
        """External declarations in [at, end). Gives where it stopped: unless last, before one that may go on behind end."""
        while at < end and (after := self.external(at, end, last)) is not None:
            at = after
        return at

    def external(self, at: int, end: int, last: bool) -> int | None:
        if self.is_(at, ";"):
            return at + 1
        if self.is_(at, "extern") and at + 2 < end and self.t[at + 1].kind == "str" and self.is_(at + 2, "{"):
            self.unit(at + 3, self.partner[at + 2])
            return self.partner[at + 2] + 1
        i, params, assigned = at, None, False
        while i < end:
            t = self.t[i]
            if self.is_(i, ";") and not self.old_style(params):
                self.simple(at, i, None)
                return i + 1
            if self.is_(i, "="):
                assigned = True
            if self.is_(i, "(") and params is None and not assigned and i > at and self.t[i - 1].text not in KEYWORDS:
                params = i
            if self.is_(i, "{"):
                if not assigned and not self.tagged(at, i) and params is not None:
                    return self.function(at, i)
                if not assigned and not self.tagged(at, i):
                    self.unit(i + 1, self.partner[i])  # a block behind a macro or the like
                    return self.partner[i] + 1
            i = self.skip(i) if t.kind == "op" else i + 1
        if not last:
            return None
        self.simple(at, end, None)
        return end

    def old_style(self, params: int | None) -> bool:
        """Whether parameter declarations follow the parameter list."""
        after = self.partner[params] + 1 if params is not None else len(self.t)
        return after + 1 < len(self.t) and self.t[after].kind == "id" and not self.t[after].text.startswith("__") and not self.is_(after + 1, ";") and self.t[after].text not in ("asm", "extern", "static", "typedef")

    def tagged(self, at: int, brace: int) -> bool:
        """Whether the brace opens the body of a struct, union or enum."""
        i = brace - 1
        if self.name(i):
            i -= 1
        while i > at and self.is_(i, ")"):  # attributes
            i = self.opened[i] - 1
            if self.t[i].text.startswith("__a"):
                i -= 1
        return i >= at and self.t[i].kind == "id" and self.t[i].text in TAGS

    def declarator(self, at: int, end: int) -> tuple[int, int] | None:
        """(name, stars before it) of the plain function declarator in [at, end): name, parameters, and nothing that wraps the name."""
        i, stars = at, 0
        while i < end:
            if self.is_(i, "*"):
                stars += 1
            elif self.is_(i, "("):
                if self.t[i - 1].text in ("__attribute__", "__attribute", "__declspec", "_Alignas", "__asm__", "asm", "typeof", "__typeof__", "_Atomic"):
                    i = self.skip(i)
                    continue
                return (i - 1, stars) if i > at and self.name(i - 1) else None
            elif self.is_(i, "{") or self.is_(i, "["):
                i = self.skip(i)
                continue
            i += 1
        return None

    def function(self, at: int, brace: int) -> int:
        close = self.partner[brace]
        found = self.declarator(at, brace)
        if not found or found[0] == at:
            if found:  # a name without a type: old style, or a macro call before a block
                self.define(at, found[0], brace, close, 0)
            return close + 1
        self.define(at, found[0], brace, close, found[1])
        return close + 1

    def define(self, at: int, name: int, brace: int, close: int, stars: int) -> None:
        self.types_in(at, brace)
        who = self.t[name].text
        if stars <= 1:
            self.facts.definitions.append((who, self.t[name].line, any(self.is_(i, "static") for i in range(at, name))))
        self.head_types(at, name, who)
        self.params(name + 1, who)
        for i in range(self.partner[name + 1] + 1, brace):  # old-style parameter declarations
            if self.is_(i - 1, ")") or self.is_(i - 1, ";"):
                self.type_at(i, brace, who)
        self.body(brace + 1, close, who)

    # -- types -------------------------------------------------------------
    def types_in(self, at: int, end: int) -> None:
        """Named types with bodies."""
        for i in range(at, end):
            if self.t[i].text in TAGS and self.t[i].kind == "id" and self.name(i + 1) and self.is_(i + 2, "{"):
                self.facts.types.append((self.t[i + 1].text, self.t[i + 1].line, TAGS[self.t[i].text]))

    def use(self, i: int, who: str | None) -> None:
        if who is not None:
            self.facts.type_uses.append((who, self.t[i].text, self.t[i].line))

    def head_types(self, at: int, end: int, who: str | None) -> None:
        """Type names among specifiers."""
        for i in range(at, end):
            if self.name(i) and not self.is_(i + 1, "("):
                self.use(i, who)

    def params(self, open_: int, who: str | None) -> None:
        """Type names in a parameter list: the first name of each parameter, and tags."""
        i, close, first = open_ + 1, self.partner[open_], True
        while i < close:
            if self.is_(i, ","):
                first = True
            elif self.t[i].kind == "id" and self.t[i].text in TAGS and self.name(i + 1):
                self.use(i + 1, who)
                first, i = False, i + 1
            elif self.name(i) and first:
                self.use(i, who)
                first = False
            elif self.t[i].kind == "id" and self.t[i].text in PRIMITIVE:
                first = False
            elif self.is_(i, "(") and self.is_(self.partner[i] + 1, "("):  # a function pointer
                self.params(self.partner[i] + 1, who)
                i = self.partner[self.partner[i] + 1]
            i += 1

    def type_at(self, i: int, end: int, who: str | None) -> int:
        """If a declaration begins at i, note its type and return the place of the first declarator, else i."""
        start = i
        while i < end and self.t[i].kind == "id" and self.t[i].text in QUALIFIERS:
            i += 1
        if i >= end or self.t[i].kind != "id":
            return start
        word = self.t[i].text
        if word in TAGS:
            j = i + 1
            if self.name(j):
                self.use(j, who)
                j += 1
            return self.skip(j) if self.is_(j, "{") else j
        if word in PRIMITIVE:
            while i < end and self.t[i].kind == "id" and (self.t[i].text in PRIMITIVE or self.t[i].text in QUALIFIERS):
                i += 1
            return i
        if self.name(i):
            j = i + 1
            while j < end and (self.is_(j, "*") or (self.t[j].kind == "id" and self.t[j].text in QUALIFIERS)):
                j += 1
            ends = j < end and self.name(j) and (j + 1 >= end or self.t[j + 1].text in (";", "=", ",", "[", "(", ":", ")"))
            pointer = self.is_(j, "(") and self.is_(j + 1, "*") and self.is_(self.partner[j] + 1, "(") and j > i + 1
            if ends or pointer:
                self.use(i, who)
                return j
        return i if i > start else start

    # -- declarations and statements -----------------------------------------
    def simple(self, at: int, end: int, who: str | None) -> None:
        """A declaration without a function body, in [at, end)."""
        self.types_in(at, end)
        if self.is_(at, "typedef") or self.is_(at + 1, "typedef"):
            self.typedef(at, end)
            return
        first = self.type_at(at, end, None)
        if first == at and not self.name(at):
            return
        self.prototypes(max(first, at + 1) if first == at else first, end)

    def parts(self, at: int, end: int) -> list[tuple[int, int]]:
        """[at, end) cut at its own commas."""
        out, i, start = [], at, at
        while i < end:
            if self.is_(i, ","):
                out.append((start, i))
                start = i + 1
            i = self.skip(i)
        return [*out, (start, end)]

    def prototypes(self, at: int, end: int) -> None:
        for a, b in self.parts(at, end):
            if any(self.is_(i, "=") for i in range(a, b)):
                continue
            found = self.declarator(a, b)
            if found and found[1] <= 1:
                self.facts.declarations.append((self.t[found[0]].text, self.t[found[0]].line))

    def typedef(self, at: int, end: int) -> None:
        """Plain names only: no pointers, arrays or functions."""
        i = at
        while i < end and self.t[i].kind == "id" and (self.t[i].text == "typedef" or self.t[i].text in QUALIFIERS):
            i += 1
        if i < end and self.t[i].text in TAGS:
            i += 2 if self.name(i + 1) else 1
            i = self.skip(i) if self.is_(i, "{") else i
        elif i < end and self.t[i].text in PRIMITIVE:
            while i < end and self.t[i].kind == "id" and (self.t[i].text in PRIMITIVE or self.t[i].text in QUALIFIERS):
                i += 1
        else:
            i += 1
        while i < end and self.t[i].kind == "id" and self.t[i].text in QUALIFIERS:
            i += 1
        for a, b in self.parts(i, end):
            if b == a + 1 and self.name(a):
                self.facts.types.append((self.t[a].text, self.t[a].line, "Typedef"))

    def body(self, at: int, end: int, who: str) -> None:
        """Statements of a function: declarations, calls, casts."""
        i, starts = at, True
        self.types_in(at, end)
        while i < end:
            t = self.t[i]
            if t.kind == "run":
                self.facts.calls += [(who, name, t.line + k) for k, name in enumerate(_FIRST.findall(t.text))]
                i, starts = i + 1, True
                continue
            text = t.text if t.kind != "str" else ""
            call = t.kind == "id" and self.is_(i + 1, "(") and self.name(i)
            if starts and t.kind == "id" and not call:  # a name right before a bracket is no type
                if t.text == "typedef":
                    stop = self.statement_end(i, end)
                    self.typedef(i, stop)
                    i = stop
                    continue
                first = self.type_at(i, end, who)
                if first > i:
                    if self.tag_body(i, first):
                        self.fields(i, first, who)
                    stop = self.statement_end(first, end)
                    self.prototypes_in(first, stop, who)
                    i, starts = first, False
                    continue
            starts = False
            if call and not (self.is_(i - 1, ".") or self.is_(i - 1, "->")):
                if i in self.declared:
                    i = self.partner[i + 1] + 1
                    continue
                self.facts.calls.append((who, t.text, t.line))
            elif text == "(" and i > at:
                self.cast(i, who)
            elif t.kind == "id" and text in TAGS and self.name(i + 1):
                self.use(i + 1, who)
            if t.kind == "op" and text in (";", "{", "}", ":"):
                starts = True
            elif text == "(" and self.is_(i - 1, "for"):
                starts = True
            elif text in (")", "else", "do"):
                starts = text != ")" or self.controls(i)
            i += 1

    def controls(self, close: int) -> bool:
        """Whether the bracket closes the head of an if, while, for or switch."""
        open_ = self.opened.get(close)
        return open_ is not None and open_ > 0 and self.t[open_ - 1].text in ("if", "while", "for", "switch")

    def statement_end(self, i: int, end: int) -> int:
        while i < end and not self.is_(i, ";") and not self.is_(i, ")"):
            i = self.skip(i)
        return min(i, end)

    def tag_body(self, at: int, first: int) -> bool:
        return first > at and self.is_(first - 1, "}")

    def fields(self, at: int, end: int, who: str) -> None:
        """Type names of the fields of a local type."""
        i = at
        while i < end:
            if self.is_(i, "{") or self.is_(i, ";"):
                self.type_at(i + 1, end, who)
            i += 1

    def prototypes_in(self, at: int, end: int, who: str) -> None:
        """Prototypes inside a body; their names are no calls, and their parameters name types."""
        for a, b in self.parts(at, end):
            if any(self.is_(i, "=") for i in range(a, b)):
                continue
            found = self.declarator(a, b)
            if found:
                self.declared.add(found[0])
                self.params(found[0] + 1, who)
                if found[1] <= 1:
                    self.facts.declarations.append((self.t[found[0]].text, self.t[found[0]].line))

    def cast(self, open_: int, who: str) -> None:
        """(T) x and (T *) x; sizeof (T *)."""
        close, i = self.partner[open_], open_ + 1
        while i < close and self.t[i].kind == "id" and self.t[i].text in QUALIFIERS:
            i += 1
        if not self.name(i):
            return
        j, stars = i + 1, 0
        while j < close and (self.is_(j, "*") or (self.t[j].kind == "id" and self.t[j].text in QUALIFIERS)):
            stars += self.is_(j, "*")
            j += 1
        if j != close or (self.t[open_ - 1].kind == "id" and self.t[open_ - 1].text not in ("return", "sizeof", "case", "else", "do")):
            return
        after = self.t[close + 1] if close + 1 < len(self.t) else None
        operand = after is not None and (after.kind in ("num", "str", "chr") or (after.kind == "id" and after.text not in KEYWORDS - {"sizeof"}) or after.text in ("{", "~", "!"))
        if stars or operand:
            if not self.controls(close):
                self.use(i, who)


#: The name that each line of a run begins with.
_FIRST = re.compile(r"^[ \t]*([A-Za-z0-9_$]+)", re.M)


def _in_bodies(found: Iterator[Token]) -> Iterator[Token]:
    """Tokens with those runs taken apart that do not stand at the begin of a statement right in a function's body, or that call a word that is no name."""
    depth, last, head, inside = 0, Token("op", ";", 0), False, False
    for t in found:
        if t.kind == "run":
            if depth == 1 and inside and (last.kind == "run" or last.kind == "op" and last.text in (";", "{")) and not any(n in KEYWORDS or n in PRIMITIVE for n in _FIRST.findall(t.text)):
                yield t
                last = t
                continue
            parts: Iterator[Token] = tokens(t.text, Scan([], [], False), line=t.line)
        else:
            parts = (t,)
        for t in parts:
            if t.kind == "op":
                if t.text in PAIRS:
                    if not depth:
                        # a brace opens a body behind parameters whose name is no keyword
                        inside = t.text == "{" and head and last.kind == "op" and last.text == ")"
                        head = t.text == "(" and last.kind == "id" and last.text not in KEYWORDS
                    depth += 1
                elif t.text in ")]}":
                    depth -= 1
            yield t
            last = t


def _pieces(found: Iterator[Token], size: int) -> Iterator[tuple[list[Token], bool]]:
    """(tokens, whether they are the last), cut outside all brackets behind a semicolon or a closing brace. A run counts as its tokens."""
    out, depth, n = [], 0, 0
    for t in found:
        out.append(t)
        n += 1 if t.kind != "run" else 5 * t.text.count("\n")
        if t.kind == "op":
            if t.text in PAIRS:
                depth += 1
            elif t.text in ")]}":
                depth -= 1
                if depth < 0:
                    raise _Broken
            if not depth and n >= size and t.text in (";", "}"):
                yield out, False
                out, n = [], 0
    yield out, True


def extract(source: str, take: Callable[[Facts], None] | None = None, size: int = PIECE, runs: bool = True) -> Facts | None:
    """The facts of a source, or None for a syntax error. runs: whether lines of plain calls are read together, which changes no fact.

    take: gets the facts of every piece (includes at the end) and may empty the lists. What it got of a source that turns out broken is void.
    """
    found, facts, rest, kept = Scan([], [], False), Facts(), [], 0
    try:
        for piece, last in _pieces(_in_bodies(tokens(source, found, runs)), size):
            if found.broken:
                return None
            rest += piece
            if not last and len(rest) < 2 * kept:  # a long declaration: wait for as much again
                continue
            rest = rest[_Reader(rest, facts).unit(0, len(rest), last) :]
            kept = len(rest)
            if take:
                _sort(facts)
                take(facts)
    except _Broken:
        return None
    facts.includes = found.includes
    _sort(facts)
    if take:
        take(facts)
    return facts


def _sort(facts: Facts) -> None:
    for one in (facts.declarations, facts.types):
        one.sort(key=lambda x: x[1])


def dump_tokens(source: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of every token: a debugging aid."""
    return [(t.kind, t.text, t.line) for t in scan(source).tokens]
