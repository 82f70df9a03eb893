"""Command line: python -m tracewright <command>. Exit 0 for an answer, empty or not; 1 for a failure; 2 for wrong usage."""

from __future__ import annotations

import argparse
import sys

NAMED = {
    "find-definition": "where a function is defined",
    "find-declarations": "where a function is declared",
    "who-calls": "the functions that call it",
    "blast-radius": "all that transitively depend on it",
    "include-graph": "what a file includes and what includes it",
    "who-uses-type": "the functions that use a type",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracewright", description="Code-graph analytics for C on Spark.")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in NAMED.items():
        s = sub.add_parser(name, help=what)
        s.add_argument("name")
        s.add_argument("--dir", required=True)
        s.add_argument("--depth", action="store_true", help="show hop counts") if name == "blast-radius" else None
    s = sub.add_parser("parse", help="the nested outline of a source")
    s.add_argument("file")
    sub.add_parser("serve", help="answer tool calls, one JSON message a line")
    s = sub.add_parser("index", help="index a tree and store the index beside it")
    s.add_argument("path")
    s = sub.add_parser("bench", help="time indexing and queries")
    s.add_argument("path")
    s.add_argument("--runs", type=int, default=5)
    s.add_argument("--sample", type=int, default=50)
    s.add_argument("--json", action="store_true")
    s = sub.add_parser("eval", help="score text search and graph against ground truth")
    s.add_argument("path")
    s.add_argument("--truth", required=True)
    s.add_argument("--json", action="store_true")
    return p


def session(master: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(master).appName("tracewright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(args: argparse.Namespace, spark=None) -> int:
    from .plans import benchmark, evaluate
    from .plans.index import build_index, load_or_index
    from .sources import store
    from .sources.c_outline import outline

    if args.command == "parse":
        with open(args.file, "rb") as f:
            for line in outline(f.read()):
                print(line)
        return 0
    spark = spark or session(args.master)
    if args.command == "serve":
        from .tools import serve

        serve(spark, sys.stdin, sys.stdout)
        return 0
    if args.command == "index":
        graph = build_index(spark, args.path)
        path = f"{args.path.rstrip('/')}/{store.DEFAULT_NAME}"
        try:
            graph.save(path)
        except Exception as e:  # an index that can't be kept is still an answer
            print(f"warning: the index was not stored: {e}", file=sys.stderr)
        graph.report_diagnostics()
        r = graph.summary().first()
        print(f"files {r.files}\nnodes {r.nodes}\nedges {r.edges or 0}\nskipped {r.skipped}")
        return 0
    if args.command == "bench":
        report = benchmark.benchmark(spark, args.path, args.runs, args.sample)
        print(benchmark.as_json(report) if args.json else benchmark.summary(report))
        return 0
    if args.command == "eval":
        report = evaluate.evaluate(spark, args.path, args.truth)
        print(report.as_json() if args.json else report.summary())
        return 0
    graph = load_or_index(spark, args.dir)
    if args.command in ("who-calls", "blast-radius"):
        graph.report_diagnostics()
    answer = getattr(graph, args.command.replace("-", "_"))(args.name)
    for r in answer.collect():
        if args.command == "include-graph":
            print(" ".join(x for x in r if x is not None))
        elif args.command == "blast-radius" and args.depth:
            print(f"{r.file}:{r.line} {r.depth}")
        else:
            print(f"{r.file}:{r.line}")
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        return run(args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        from pyspark.sql import SparkSession

        from .functions.storage import release

        if spark := SparkSession.getActiveSession():
            release(spark)
