"""Small C trees of our own, one per shape."""

TREES = {
    "calls": {
        "app.c": "int aid(int x) { return x; }\n\n\nint go(void)\n{\n    int a = aid(1);\n    return a + work(aid(2));\n}\n\nint main(void) { go(); return aid(3); }\n",
        "lib.c": "int work(int n) {\n  return aid(n);\n}\n",
        "one.c": "int both(void) { return 1; }\nint asks(void) {\n  return both();\n}\n",
        "two.c": "int both(void) { return 2; }\n",
    },
    "linkage": {
        "a.c": "static int hide(void) { return 1; }\nint uses_own(void) { return hide(); }\n",
        "b.c": "int hide(void) { return 2; }\nint uses_ext(void) { return hide(); }\n",
        "c.c": "static int only(void) { return 3; }\n",
        "d.c": "int only(void);\nint hide(void);\nint ask(void) { return only(); }\n",
        "e.c": "#if X\nint twice(void) { return hide(); }\n#else\nint twice(void) { return 1; }\n#endif\nint self(int n) { return n ? self(n - 1) : twice(); }\n",
    },
    "chain": {
        "chain.c": "int low(void) { return 0; }\nint mid(void) { return low(); }\nint top(void) { return mid(); }\n",
        "ring.c": "int ring_a(void);\nint low(void);\nint ring_b(void) { return ring_a() + low(); }\nint ring_a(void) { return ring_b(); }\n",
    },
    "includes": {
        "src/app.c": '#include <stdio.h>\n#include "util.h"\n#include "../inc/conf.h"\n  #  include "gone.h"\n#include <util.h>\n/* #include "no.h" */\nint main(void) { return 0; }\n',
        "src/util.h": '#include "../inc/conf.h"\n',
        "inc/conf.h": "\n",
        "inc/util.h": "// another of the same name\n",
    },
    "types": {
        "t.h": "struct Point {\n  int x;\n};\nenum Hue { RED, BLUE };\nunion Any { int i; float f; };\ntypedef double Heat;\ntypedef struct Point *PointPtr, Pair;\ntypedef int Arr[3];\ntypedef void (*Fn)(int);\n",
        "u.c": '#include "t.h"\nint px(struct Point p) { return p.x; }\nstruct Point origin(enum Hue h) {\n  struct Point p;\n  return p;\n}\nHeat warm(void) { Heat h = 0; return (Heat)h; }\nint plain(int a) { return a; }\nint cast(void *v) { return ((union Any *)v)->i; }\n',
    },
    "bad": {"ok.c": "int f(void) { return 1; }\n", "sub/broken.c": "int g(void) { return (1;\n", "sub/open.h": "/* never closed\n", "_hidden.c": "int h(void) { return f(); }\n", ".dot/deep.h": "int f(void);\n", "empty.c": "", "note.txt": "int no(void) {}"},
}


def write(tree: str, folder) -> str:
    for rel, text in TREES[tree].items():
        path = folder / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(folder)
