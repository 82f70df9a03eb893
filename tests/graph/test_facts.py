"""The C recogniser alone."""

import tracemalloc

import pyarrow as pa
import pytest

from tracewright.functions.scalars import content_hash, human_bytes, include_target, unsigned
from tracewright.sources import trees
from tracewright.sources.c_facts import Facts, _in_bodies, dump_tokens, extract
from tracewright.sources.c_tokens import Scan, tokens
from tracewright.sources.truth import parse_line

CASES = [
    ("int f(void) { return 1; }", "definitions", [("f", 1, False)]),
    ("static char *name(void)\n{ return 0; }", "definitions", [("name", 1, True)]),
    ("int **twice(void) { return g(); }", "definitions", []),
    ("int *(wrapped)(void) { return 0; }", "definitions", []),
    ("int (*get(void))(int) { return h(); }", "calls", []),
    ("int old(a, b) int a; char *b; { return g(a); }", "definitions", [("old", 1, False)]),
    ("int old(a) int a; { return g(a); }", "calls", [("old", "g", 1)]),
    ("__attribute__((noinline)) static int f(void) { return 1; }", "definitions", [("f", 1, True)]),
    ('extern "C" {\nint f(void) { return g(); }\n}', "definitions", [("f", 2, False)]),
    ("int a(void), *b(int), **c(int), d, (*e)(int);", "declarations", [("a", 1), ("b", 1)]),
    ("int f(void) { int g(int); return g(1); }", "declarations", [("g", 1)]),
    ("int f(void) { int g(int); return g(1); }", "calls", [("f", "g", 1)]),
    ("typedef int Fn(int);\nextern int x;\nint y = f(2);", "declarations", []),
    ("int y = f(2);", "calls", []),
    ("int f(void) { p->g(1); q.h(2); (k)(3); if (m(4)) while (n(5)) ; return sizeof(o) + r(s(6)); }", "calls", [("f", "m", 1), ("f", "n", 1), ("f", "r", 1), ("f", "s", 1)]),
    ('int f(void) { /* g(); */ // h();\n return "i()"[0] + \'(\'; }', "calls", []),
    ("#define CALL(x) x()\nint f(void) {\n#if A\n  a();\n#else\n  b();\n#endif\n}", "calls", [("f", "a", 4), ("f", "b", 6)]),
    ("#define M do { \\\n  x(); \\\n} while (0)\nint f(void) { return y(); }", "calls", [("f", "y", 4)]),
    ("struct S { int a; };\nstruct T;\nstruct { int b; } anon;\nenum E { A };\nunion U { int i; } u;", "types", [("S", 1, "Struct"), ("E", 4, "Enum"), ("U", 5, "Union")]),
    ("typedef struct S { int a; } A, *B;\ntypedef A C;\ntypedef A *D;\ntypedef unsigned long G;", "types", [("S", 1, "Struct"), ("A", 1, "Typedef"), ("C", 2, "Typedef"), ("G", 4, "Typedef")]),
    ("T f(A a, const B *b, int n, struct C c) { D d; E *e = 0; for (G g = 0; ; ) x = (H *)e; return a * n; }", "type_uses", [("f", t, 1) for t in "TABCDEGH"]),
    ("int f(int a) { a * b; size_t n; return a; }", "type_uses", [("f", "a", 1)]),
    ("int add(int a, int b) { return a + b; }", "type_uses", []),
]


@pytest.mark.parametrize("source,relation,want", CASES)
def test_facts(source, relation, want):
    assert getattr(extract(source), relation) == want


@pytest.mark.parametrize("source", ["int f(void) {", "int f(void) { return (1; }", "}", "/* open", 'char *s = "open;\n', "int a[2;"])
def test_syntax_errors(source):
    assert extract(source) is None


def test_scalars():
    assert content_hash(b"a") == 4953267810257967366 and unsigned(content_hash(b"")) == 1469598103934665603
    assert include_target("src/a.c", "../inc/./b.h") == "inc/b.h" and include_target("a.c", "/x/y.h") == "/x/y.h"
    assert human_bytes(512) == "512 B" and human_bytes(2048) == "2.0 KiB"
    assert [t[1] for t in dump_tokens("a->b++ /* x */;")] == ["a", "->", "b", "++", ";"]


def test_truth_lines():
    assert parse_line("who-calls f a.c:3 b:c.c:4", "t:1") == ("who-calls", "f", [("a.c", 3), ("b:c.c", 4)])
    assert parse_line("  # note", "t:1") is None and parse_line("", "t:1") is None and parse_line("who-calls f", "t:1")[2] == []
    for bad in ("nope f", "who-calls", "who-calls f a.c", "who-calls f a.c:x", "who-calls f :3"):
        with pytest.raises(ValueError, match="t:9"):
            parse_line(bad, "t:9")


@pytest.mark.parametrize("source", [c[0] for c in CASES] + ["int old(a) int a; { return g(a); }\nstruct S { int v; } s; int f(void) { return g(); }", "int f(void) {}\n}", "int f(void) { g() }\nint y"])
def test_pieces_change_nothing(source):
    whole, parts = extract(source), Facts()

    def take(facts):
        for name, rows in vars(facts).items():
            getattr(parts, name).extend(rows)
            rows.clear()

    done = extract(source, take, size=1)
    assert (None if done is None else parts) == whole == extract(source, size=1)


RUN = "  h(1);\n  k(a, b2);\n  h();\n"


@pytest.mark.parametrize("source", [c[0] for c in CASES] + [f"int f(void) {{\n{RUN}  if (x) {{\n{RUN}  }}\n  struct S {{ int v; }}\n{RUN}  T\n{RUN}  else\n{RUN}  int(1);\n}}\n", f"extern \"C\" {{\n{RUN}}}\nif (x) {{\n{RUN}}}\nstruct S {{\n{RUN}}};\nint x =\n{RUN}", f"int f(void) {{\n{RUN}  g() }}\n", f"int x = f(a) {{\n{RUN}}};\n{RUN}int f(a) int a; {{\n{RUN}}}\n"])
def test_lines_of_calls_read_together_change_nothing(source):
    assert extract(source) == extract(source, size=1) == extract(source, runs=False)


def test_lines_of_calls_are_few_tokens():
    """In a body, up to 64 lines are one; elsewhere each is taken apart."""
    body = "".join(f"  g{k}(1);\n" for k in range(640))
    made = list(_in_bodies(tokens("int f(void) {\n" + body + "}\n", Scan([], [], False), True)))
    assert len(made) == 17 and [t.line for t in made[6:16]] == list(range(2, 642, 64))
    apart = "int x;\n" + body
    assert list(_in_bodies(tokens(apart, Scan([], [], False), True))) == list(tokens(apart, Scan([], [], False)))
    assert [c[1:] for c in extract("int f(void) {\n" + body + "}\n").calls] == [(f"g{k}", k + 2) for k in range(640)]


def test_a_large_source_takes_little_memory():
    """Its functions are read one after the other, and its facts lie in Arrow columns."""
    data = b"".join(b"int f%d(int *p) {\n%s}\n" % (k, b"  g(1);\n" * 30) for k in range(2_000))
    rows = trees._Artifacts()
    rows.add("/b.c", "b.c", b"int f(void) { g(); }")
    rows.batch()  # what is loaded at first use
    tracemalloc.start()
    rows = trees._Artifacts()
    rows.add("/a.c", "a.c", data)
    batch = rows.batch()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(batch.column("calls")[0]) == 60_000 and len(batch.column("definitions")[0]) == 2_000
    assert batch.column("calls")[0][59_999].as_py() == {"caller": "f1999", "callee": "g", "line": 63_999}
    assert peak < 10e6


def test_facts_of_a_large_source_lie_in_rows_of_bounded_size():
    """Readers take thousands of rows at once. The rows of a file together have its facts, in order; the first has all else."""
    source = b"int f(struct T *p) {\n%s}\nint g(void) { return 0; }\n" % (b"  h(1);\n" * (2 * trees.PART + 1))
    files = [("/a.c", "a.c", b"int a(void) { b(); }"), ("/b.c", "b.c", source), ("/c.c", "c.c", b"@"), ("/d.c", "d.c", None), ("/e.h", "e.h", b'#include "b.h"\n' * (trees.PART + 1))]
    rows = [r for b in trees._batches(iter(files)) for r in b.to_pylist()]
    assert max(len(r[n]) for r in rows for n in trees.PARTED) == trees.PART
    assert [r["path"] for r in rows] == ["/a.c", "/b.c", "/b.c", "/b.c", "/c.c", "/d.c", "/e.h", "/e.h"]
    assert [r["bytes"] is None for r in rows] == [r["lines"] is None for r in rows] == [False, False, True, True, False, False, False, True]
    assert len({(r["status"], r["hash"]) for r in rows if r["path"] == "/b.c"}) == 1
    assert [c["line"] for r in rows[1:4] for c in r["calls"]] == list(range(2, 2 * trees.PART + 3))
    assert [[d["name"] for d in r["definitions"]] for r in rows[:5]] == [["a"], ["f", "g"], [], [], []]
    assert [len(r["type_uses"]) for r in rows[1:4]] == [1, 0, 0] and [i["line"] for r in rows[6:] for i in r["includes"]] == list(range(1, trees.PART + 2))


def test_a_file_in_pieces_is_joined_over_batches():
    rows = [(None, "", b"x"), ("/a.c", "a.c", b"int a;"), ("/a.c", "a.c", None), ("/a.c", "a.c", b"int b;\nint c;"), ("/b.c", "b.c", None), ("/c.c", "c.c", b"")]
    want = [(None, "", b"x\n"), ("/a.c", "a.c", b"int a;\nint b;\nint c;\n"), ("/b.c", "b.c", b"\n"), ("/c.c", "c.c", b"\n")]
    kind = pa.schema([("path", pa.string()), ("rel", pa.string()), ("text", pa.binary())])
    for size in (1, 2, 4, len(rows)):
        batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows[at : at + size]], kind) for at in range(0, len(rows), size)]
        assert list(trees._joined(iter([*batches, batches[0][:0]]))) == want


def test_facts_that_are_not_kept_take_no_memory():
    data = b"".join(b"int f%d(int *p) {\n%s}\n" % (k, b"  g(1);\n" * 30) for k in range(2_000))
    list(trees._batches(iter([("/b.c", "b.c", b"int f(void) { g(); }")]), ("definitions",)))  # what is loaded at first use
    before = pa.total_allocated_bytes()
    (batch,) = trees._batches(iter([("/a.c", "a.c", data)]), ("definitions",))
    assert pa.total_allocated_bytes() - before < 200_000
    assert batch.to_pylist()[0]["definitions"][-1] == {"name": "f1999", "line": 63_969, "is_static": False}
    assert [len(batch.column(n)[0]) for n in trees.RELATIONS] == [2_000, 0, 0, 0, 0, 0] and batch.column("lines")[0].as_py() == 64_000


@pytest.mark.parametrize("keep", [trees.RELATIONS, ("calls",)])
def test_pieces_are_parsed_as_whole_files(spark, keep):
    pieces = [(f"/{f}.c", f"{f}.c", k, f'#include "x.h"\nint f{k}(struct T *p) {{\n  g{k}(1);\n}}') for f in "ab" for k in (3, 1, 2)]
    wholes = [(f"/{f}.c", f"{f}.c", "\n".join(p[3] for p in sorted(pieces) if p[1] == f"{f}.c") + "\n") for f in "ab"]
    found = trees.parse_pieces(spark.createDataFrame(pieces, "path string, rel string, at int, text string"), keep).orderBy("path").collect()
    whole = trees.parse_contents(spark.createDataFrame(wholes, "path string, rel string, content string")).orderBy("path").collect()
    for a, b in zip(found, whole, strict=True):
        assert all(a[n] == ([] if n in trees.RELATIONS and n not in keep else b[n]) for n in b.asDict())


def test_foreign_space_is_a_syntax_error():
    assert extract("int f(void) {　return 1; }") is None
