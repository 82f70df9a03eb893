"""Indexing trees, and every question asked of the graph."""

import os

import pytest

from tests.graph.sources import TREES, write
from tracewright import cli
from tracewright.functions.scalars import whole_word
from tracewright.operators import measure, navigate, search
from tracewright.plans import benchmark, evaluate
from tracewright.plans.index import Graph, build_index, load_or_index, reindex
from tracewright.sources import store, trees
from tracewright.streaming.watch import merged
from tracewright.sources.c_facts import extract
from tracewright.sources.c_outline import outline
from tracewright.tools import ToolError, Tools, serve


@pytest.fixture(scope="session")
def graphs(spark, tmp_path_factory):
    made = {}

    def get(tree: str) -> Graph:
        if tree not in made:
            root = write(tree, tmp_path_factory.mktemp(tree))
            g = build_index(spark, root)
            g.root = root
            made[tree] = g
        return made[tree]

    return get


def at(g, df):
    return [(os.path.relpath(r["file"], g.root), r["line"]) for r in df.collect()]


def test_calls(graphs):
    g = graphs("calls")
    assert at(g, g.find_definition("both")) == [("one.c", 1), ("two.c", 1)] and at(g, g.find_definition("none")) == []
    assert at(g, g.who_calls("aid")) == [("app.c", 4), ("app.c", 10), ("lib.c", 1)]
    assert at(g, g.who_calls("work")) == [("app.c", 4)] and at(g, g.who_calls("main")) == []
    assert at(g, g.call_sites("aid")) == [("app.c", 6), ("app.c", 7), ("app.c", 10), ("lib.c", 2)]
    clash = g.diagnostics.collect()
    assert [(r.callee, r.caller_line, len(r.candidates)) for r in clash] == [("both", 3, 2)]
    assert g.calls.count() == 8 and g.edge_count() == 8
    ids = sorted(r.node_id for r in g.nodes.collect())
    assert ids == list(range(len(ids))) and g.size() == len(ids)
    assert g.callees_of(g.nodes_named("asks")).count() == 2


def test_linkage(graphs):
    g = graphs("linkage")
    assert at(g, g.who_calls("hide")) == [("a.c", 2), ("b.c", 2), ("e.c", 2)]
    own = g.nodes.where("name = 'hide' and linkage = 'Internal'")
    assert at(g, g.nodes.join(g.callers_of(own), "node_id")) == [("a.c", 2)]
    assert at(g, g.who_calls("only")) == []
    links = {r["name"]: r["def"] for r in g.declares.join(g.nodes, g.nodes.node_id == g.declares.decl).collect()}
    targets = {r.node_id: (os.path.relpath(r.file, g.root), r.line) for r in g.nodes.collect()}
    assert {k: targets[v] for k, v in links.items()} == {"only": ("c.c", 1), "hide": ("b.c", 1)}
    assert g.definition_of(g.nodes.where("kind = 'FunctionDecl'")).count() == 2
    assert at(g, g.find_declarations("only")) == [("d.c", 1)]
    assert at(g, g.who_calls("self")) == [("e.c", 6)] and at(g, g.blast_radius("self")) == []
    assert at(g, g.find_definition("twice")) == [("e.c", 2), ("e.c", 4)]


def test_blast_radius(graphs):
    g = graphs("chain")
    depth = lambda n: [(os.path.relpath(r.file, g.root), r.line, r.depth) for r in g.blast_radius(n).collect()]
    assert depth("low") == [("chain.c", 2, 1), ("chain.c", 3, 2), ("ring.c", 3, 1), ("ring.c", 4, 2)]
    assert depth("mid") == [("chain.c", 3, 1)] and depth("ring_a") == [("ring.c", 3, 1)] and depth("top") == []
    assert {r.depth for r in g.transitive_callers(g.nodes_named("low")).collect()} == {1, 2}
    assert navigate.transitive_callers(g.calls, g.nodes_named("low"), max_levels=1).count() == 2


def test_includes(graphs):
    g = graphs("includes")
    got = [(r.section, os.path.relpath(r.value, g.root) if r.section != "unresolved" else r.value, r.tag) for r in g.include_graph("app.c").collect()]
    assert got == [("includes", "inc/conf.h", None), ("includes", "src/util.h", None), ("unresolved", "gone.h", "external"), ("unresolved", "stdio.h", "system"), ("unresolved", "util.h", "system")]
    assert [os.path.relpath(r.value, g.root) for r in g.include_graph("conf.h").collect()] == ["src/app.c", "src/util.h"]
    assert [r.section for r in g.include_graph("util.h").collect()] == ["includes", "included_by"]
    with pytest.raises(LookupError):
        g.include_graph("none.h")
    app = g.nodes_named("app.c")
    assert g.includes_of(app).count() == 2 and g.included_by(g.nodes_named("conf.h")).count() == 2


def test_types(graphs):
    g = graphs("types")
    kinds = {(r.name, r.kind) for r in g.nodes.collect() if r.kind not in ("File", "Function")}
    assert kinds == {("Point", "Struct"), ("Hue", "Enum"), ("Any", "Union"), ("Heat", "Typedef"), ("Pair", "Typedef")}
    assert at(g, g.who_uses_type("Point")) == [("u.c", 2), ("u.c", 3)] and at(g, g.who_uses_type("Hue")) == [("u.c", 3)]
    assert at(g, g.who_uses_type("Heat")) == [("u.c", 7)] and at(g, g.who_uses_type("Any")) == [("u.c", 9)]
    assert g.uses_type.count() == 8 and g.users_of(g.nodes_named("Point")).count() == 3


def test_robust(graphs):
    g = graphs("bad")
    assert sorted((os.path.relpath(r.path, g.root), r.reason) for r in g.skipped_files.collect()) == [("sub/broken.c", "syntax error"), ("sub/open.h", "syntax error")]
    files = {os.path.relpath(r.file, g.root): r.hash for r in g.nodes.where("kind = 'File'").collect()}
    assert set(files) == {"ok.c", "_hidden.c", ".dot/deep.h", "empty.c"} and len(set(files.values())) == 4
    assert at(g, g.who_calls("f")) == [("_hidden.c", 1)]
    r = g.summary().first()
    assert (r.files, r.skipped) == (4, 2)


def test_unreadable(spark):
    rows = trees.parse(spark.createDataFrame([("/nowhere/x.c", "x.c")], "path string, rel string")).collect()
    assert [r.status for r in rows] == ["unreadable"]


def everything(g):
    key = lambda df: sorted(map(repr, df.collect()))
    return {name: key(df) for name, df in g.relations.items()}


def test_store(spark, graphs, tmp_path):
    g, path = graphs("linkage"), str(tmp_path / "index")
    g.save(path)
    loaded = Graph(*store.load(spark, path))
    assert everything(loaded) == everything(g)
    loaded.save(path)  # over the folder that it reads
    assert everything(Graph(*store.load(spark, path))) == everything(g)
    with pytest.raises(store.IndexFormatError):
        store.load(spark, str(tmp_path / "none"))
    manifest = tmp_path / "index" / "manifest.json"
    text = manifest.read_text()
    (tmp_path / "index" / ".manifest.json.crc").unlink(missing_ok=True)
    for bad in (text.replace("tracewright-index", "other"), text.replace('"version": 1', '"version": 9'), "{", text.replace('"nodes": ', '"nodes": 1')):
        manifest.write_text(bad)
        with pytest.raises(store.IndexFormatError):
            store.load(spark, path)


def test_reindex(spark, tmp_path):
    root = str(tmp_path)
    (tmp_path / "a.c").write_text("int fa(void) { return fb(); }\n")
    (tmp_path / "b.c").write_text("static int fb(void) { return 1; }\n")
    (tmp_path / "x.c").write_text("int broken(\n")
    first = reindex(spark, root, build_index(spark, root).artifacts.limit(0))
    assert (first.files_parsed, first.files_reused) == (3, 0) and first.graph.who_calls("fb").count() == 0
    (tmp_path / "b.c").write_text("int fb(void) { return 1; }\n")
    second = reindex(spark, root, first.graph.artifacts)
    assert (second.files_parsed, second.files_reused) == (2, 1)
    assert [r.line for r in second.graph.who_calls("fb").collect()] == [1]
    assert everything(second.graph) == everything(build_index(spark, root))
    (tmp_path / "a.c").unlink()
    third = reindex(spark, root, second.graph.artifacts)
    assert third.graph.nodes_named("fa").count() == 0 and third.files_reused == 1


def test_watch(spark, tmp_path):
    path = str(tmp_path / "index")
    schema = "path string, rel string, content string, seq int"
    merged(spark, spark.createDataFrame([("a.c", "a.c", "int f(void) { return g(); }", 1), ("b.c", "b.c", "int g(", 1), ("b.c", "b.c", "int g(void) { return 1; }", 2)], schema), path)
    assert Graph(*store.load(spark, path)).who_calls("g").count() == 1
    merged(spark, spark.createDataFrame([("b.c", "b.c", None, 3)], schema), path)
    g = Graph(*store.load(spark, path))
    assert g.who_calls("g").count() == 0 and g.nodes_named("g").count() == 0


def test_search_and_eval(spark, graphs, tmp_path):
    g = graphs("calls")
    lines = trees.lines(trees.paths_table(spark, g.root))
    hits = sorted((r.file, r.line) for r in search.grep(lines, "aid").collect())
    assert hits == [("app.c", 1), ("app.c", 6), ("app.c", 7), ("app.c", 10), ("lib.c", 2)]
    assert search.grep(lines, "").count() == 0 and search.grep(lines, "ai").count() == 0
    assert sorted((r.symbol, r.file, r.line) for r in search.grep_many(lines, ["both", "a +"]).collect()) == [("a +", "app.c", 7), ("both", "one.c", 1), ("both", "one.c", 3), ("both", "two.c", 1)]
    odd = spark.createDataFrame([("a.b",), ("axb",), ("x a.b_",), ("(a.b)",)], "t string")
    from pyspark.sql import functions as F

    assert [r.t for r in odd.where(whole_word(F.col("t"), "a.b")).collect()] == ["a.b", "(a.b)"]
    truth = tmp_path / "truth.txt"
    truth.write_text("# rows\nfind-definition both one.c:1 two.c:1\nwho-calls aid app.c:6 app.c:7 app.c:10 lib.c:2\nwho-calls main\nfind-definition nothing\n")
    report = evaluate.evaluate(spark, g.root, str(truth))
    tools = {t["tool"]: t for t in report.tools}
    assert (tools["graph"]["precision"], tools["graph"]["recall"], tools["graph"]["queries"]) == (1.0, 1.0, 4)
    assert tools["grep"]["recall"] == 1.0 and tools["grep"]["precision"] == pytest.approx((2 / 3 + 4 / 5 + 0 + 1) / 4)
    assert '"tools"' in report.as_json() and "graph" in report.summary()


def test_scores(spark):
    q = spark.createDataFrame([("a",), ("b",)], "q string")
    t = spark.createDataFrame([("a", "f", 1), ("a", "f", 1), ("a", "f", 2)], "q string, file string, line int")
    found = spark.createDataFrame([("a", "f", 1), ("a", "g", 1)], t.schema)
    got = {r.q: (r.relevant, r.retrieved, r.true_positives, r.precision, r.recall) for r in measure.scores(t, found, q, ["q"]).collect()}
    assert got == {"a": (2, 2, 1, 0.5, 0.5), "b": (0, 0, 0, 1.0, 1.0)}


def test_sample_and_percentiles(spark):
    names = spark.createDataFrame([(f"n{i:02}",) for i in range(10)] + [("n00",)], "name string")
    pick = lambda k: sorted(r.name for r in measure.even_sample(names, k).collect())
    assert pick(3) == ["n00", "n04", "n09"] and pick(1) == ["n00"] and len(pick(0)) == 10 and len(pick(99)) == 10
    values = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "v double")
    assert values.agg(measure.percentile("v", 0.95)).first()[0] == pytest.approx(8.95)
    assert benchmark.interpolated([1, 2, 3, 10], 0.95) == pytest.approx(8.95) and benchmark.interpolated([], 0.5) == 0
    assert benchmark.thread_counts(6) == [1, 2, 4, 6] and benchmark.thread_counts(1) == [1]


def test_bench_report(spark, graphs):
    report = benchmark.benchmark(spark, graphs("chain").root, runs=1, sample=1, repeats=1)
    assert report["input"]["files"] == 2 and set(report["latency"]) == set(benchmark.QUERIES)
    assert '"persistence"' in benchmark.as_json(report) and "files/s" in benchmark.summary(report)


def test_cli(spark, graphs, capsys, tmp_path):
    g = graphs("calls")
    ask = lambda *a: cli.run(cli.parser().parse_args(a), spark)
    assert ask("index", g.root) == 0 and "nodes 11" in capsys.readouterr().out
    assert ask("who-calls", "work", "--dir", g.root) == 0
    out = capsys.readouterr()
    assert out.out.strip().endswith("app.c:4") and "both has 2 external" in out.err
    assert ask("find-definition", "none", "--dir", g.root) == 0 and capsys.readouterr().out == ""
    assert ask("blast-radius", "aid", "--dir", g.root, "--depth") == 0
    assert ask("parse", os.path.join(g.root, "lib.c")) == 0
    assert cli.main(["nope"]) == 2
    assert load_or_index(spark, g.root).size() == 11


def test_tools(spark, graphs):
    g = graphs("chain")
    t = Tools(spark, g.root)
    assert [m["line"] for m in t.find_definition("mid")["matches"]] == [2]
    assert [m["line"] for m in t.who_calls("mid")["matches"]] == [3] and len(t.blast_radius("low")["matches"]) == 4
    broken = Tools(spark, g.root, index_path="bad-scheme://x")
    with pytest.raises(ToolError):
        broken.who_calls("x")
    assert set(TREES) >= {"calls"}


def test_server(spark, graphs):
    import io
    import json

    root = graphs("chain").root
    ask = lambda i, tool, **given: json.dumps({"jsonrpc": "2.0", "id": i, "method": "tools/call", "params": {"name": tool, "arguments": given}})
    lines = [json.dumps({"jsonrpc": "2.0", "id": 1, "method": "initialize"}), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"jsonrpc": "2.0", "id": 2, "method": "tools/list"})]
    lines += [ask(3, "find_definition", name="mid", directory=root), ask(4, "who_calls", name="mid", directory=root), ask(5, "who_calls", name="mid"), ask(6, "none", name="x", directory=root), "{", ask(7, "who_calls", name="x", directory="bad-scheme://x"), "[]"]
    out = io.StringIO()
    serve(spark, io.StringIO("\n".join(lines) + "\n"), out)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [t.get("id") for t in told] == [1, 2, 3, 4, 5, 6, None, 7, None]
    assert [t["name"] for t in told[1]["result"]["tools"]] == ["find_definition", "who_calls", "blast_radius"]
    assert [m["line"] for m in told[2]["result"]["structuredContent"]["matches"]] == [2] and [m["line"] for m in told[3]["result"]["structuredContent"]["matches"]] == [3]
    assert [t["error"]["code"] for t in told if "error" in t] == [-32602, -32602, -32700, -32600] and told[7]["result"]["isError"]


def test_outline():
    got = list(outline("#include <a.h>\nint é(int a) { return a; }\nint b[2] = {1};\n".encode()))
    assert got[0] == "source [0-59] (L1:1-L4:1)" and got[1] == "  directive [0-14] (L1:1-L1:15)"
    assert [x.strip().split()[0] for x in got if x.startswith("  ") and not x.startswith("    ")] == ["directive", "definition", "declaration"]
    assert "    block [29-42] (L2:15-L2:28)" in got and any("statement" in x for x in got)


def test_deep_chain(spark):
    calls = spark.createDataFrame([(i + 1, i, 1) for i in range(30)] + [(0, 30, 1), (5, 5, 1)], "src long, dst long, call_line int")
    found = navigate.transitive_callers(calls, spark.createDataFrame([(0,)], "node_id long"))
    assert {(r.node_id, r.depth) for r in found.collect()} == {(i, i) for i in range(1, 31)}
    assert navigate.transitive_callers(calls, spark.createDataFrame([(0,)], "node_id long"), 3).count() == 3


@pytest.mark.parametrize("source", ["int f(void) { return 1 }", "int x = ;", "@@ $%", "int y", "int f(void) { if (a) { b() } }", "int a[] = {1, 2", "int f(void) { int x = ; }"])
def test_syntax_errors(source):
    assert extract(source) is None


@pytest.mark.parametrize("source", ["", ";", "int f(void){ int a[]={1,2}; struct p q=(struct p){1,2}; if(a){b();}else{c();} do{d();}while(0); L: return 1; }", "enum E {A, B}; struct S { int a; } s = { 1 };", "int f(a) int a; { return a; }", "void f(void) { switch (x) { case 1: { g(); } break; default: ; } }", 'extern "C" { int f(void); }'])
def test_sound_sources(source):
    assert extract(source) is not None
