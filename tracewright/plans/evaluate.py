"""Evaluation: text search and graph answers against ground truth, in one set-oriented job."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..model import FUNCTION
from ..operators import measure, search
from ..sources import trees
from ..sources.truth import load_truth
from .index import Graph, graph_of


@dataclass
class EvalReport:
    rows: list[dict]
    tools: list[dict]

    def as_json(self) -> str:
        return json.dumps({"tools": self.tools, "rows": self.rows}, indent=2)

    def summary(self) -> str:
        head = [f"{t['tool']:<6} precision {t['precision']:.2f}  recall {t['recall']:.2f}  ({t['queries']} queries)" for t in self.tools]
        body = [f"{r['tool']:<6} {r['query']:<16} {r['symbol']:<20} {r['true_positives']}/{r['retrieved']} of {r['relevant']}  P {r['precision']:.2f}  R {r['recall']:.2f}" for r in self.rows]
        return "\n".join([*head, "", *body])


def graph_answers(graph: Graph, queries: DataFrame, rel: DataFrame) -> DataFrame:
    """(query, symbol, file, line) for all queries at once. rel: (path, rel)."""
    names = rel.select(F.col("path").alias("file"), "rel")
    functions = graph.nodes.where(F.col("kind") == FUNCTION)
    found = functions.select(F.col("name").alias("symbol"), "file", "line").join(queries.where("query = 'find-definition'"), "symbol")
    to = functions.select(F.col("node_id").alias("dst"), F.col("name").alias("symbol"))
    at = graph.nodes.select(F.col("node_id").alias("src"), "file")
    sites = queries.where("query = 'who-calls'").join(to, "symbol").join(graph.calls, "dst").join(at, "src").select("symbol", "file", F.col("call_line").alias("line"), "query")
    both = found.select("query", "symbol", "file", "line").unionByName(sites.select("query", "symbol", "file", "line"))
    return both.join(names, "file").select("query", "symbol", F.col("rel").alias("file"), "line").distinct()


def evaluate(spark: SparkSession, root: str, truth_path: str) -> EvalReport:
    """Indexes the tree anew; scores every query for both tools."""
    queries, expected = load_truth(spark, truth_path)
    paths = cut(trees.paths_table(spark, root))
    artifacts = cut(trees.parse(paths))
    graph = graph_of(artifacts)
    symbols = sorted({r.symbol for r in queries.select("symbol").distinct().collect()})
    hits = search.grep_many(trees.lines(paths), symbols).join(queries, "symbol").select("query", "symbol", "file", "line")
    answers = {"grep": hits, "graph": graph_answers(graph, queries, trees.files_of(artifacts).select("path", "rel"))}
    scored = None
    for tool, found in answers.items():
        one = measure.scores(expected, found, queries, ["query", "symbol"]).withColumn("tool", F.lit(tool))
        scored = one if scored is None else scored.unionByName(one)
    scored = cut(scored)
    rows = [r.asDict() for r in scored.orderBy("tool", "query", "symbol").collect()]
    return EvalReport(rows, [r.asDict() for r in measure.macro(scored).orderBy("tool").collect()])
