"""Answers over a graph: lookups, one hop, and the reverse closure of calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..model import DECLARATION, FILE, FUNCTION, TYPE_KINDS

#: Levels of a closure between two writings of what was seen.
COMPACT = 4


def nodes_named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name).orderBy("node_id")


def find_definition(nodes: DataFrame, name: str) -> DataFrame:
    """(file, line) of every function of the name, repeats included, sorted."""
    return nodes.where((F.col("kind") == FUNCTION) & (F.col("name") == name)).select("file", "line").orderBy("file", "line")


def find_declarations(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where((F.col("kind") == DECLARATION) & (F.col("name") == name)).select("file", "line").orderBy("file", "line")


def neighbours(edges: DataFrame, ids: DataFrame, reverse: bool = True) -> DataFrame:
    """Node ids (repeats included) one hop from ids (column node_id): sources of edges into them, or targets of edges out of them."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return edges.join(ids.select(F.col("node_id").alias(near)), near, "left_semi").select(F.col(far).alias("node_id"))


def _sites(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return nodes.join(ids.distinct(), "node_id", "left_semi").select("file", "line").distinct().orderBy("file", "line")


def who_calls(nodes: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """(file, line) of the definitions that call anything of the name; a function that calls itself is one."""
    return _sites(nodes, neighbours(calls, nodes.where(F.col("name") == name)))


def who_uses_type(nodes: DataFrame, uses: DataFrame, name: str) -> DataFrame:
    return _sites(nodes, neighbours(uses, nodes.where((F.col("name") == name) & F.col("kind").isin(*TYPE_KINDS))))


def call_sites(nodes: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """(file, line) of the calls themselves, not of their functions."""
    to = nodes.where((F.col("name") == name) & (F.col("kind") == FUNCTION)).select(F.col("node_id").alias("dst"))
    at = nodes.select(F.col("node_id").alias("src"), "file")
    return calls.join(to, "dst", "left_semi").join(at, "src").select("file", F.col("call_line").alias("line")).distinct().orderBy("file", "line")


def definition_of(declares: DataFrame, decl_ids: DataFrame) -> DataFrame:
    return declares.join(decl_ids.select(F.col("node_id").alias("decl")), "decl", "left_semi")


def transitive_callers(calls: DataFrame, seeds: DataFrame, max_levels: int | None = None) -> DataFrame:
    """(node_id, depth): all that reach a seed over calls, with the least number of hops; never a seed itself, even on a cycle.

    The edges are reduced to distinct pairs and written once, sorted by target within files, so that a level reads
    few row groups. A level joins them with the frontier and takes away what was seen; each is written
    once. What was seen is one table of its own, made anew every few levels, so that a deep chain of
    calls reads a few tables a level and its plan stays short.
    """
    spark = calls.sparkSession
    pairs = calls.select("src", "dst").where("src <> dst").distinct()
    edges = cut(pairs.sortWithinPartitions("dst"))
    seen, recent, depth = cut(seeds.select("node_id").distinct().withColumn("depth", F.lit(0))), [], 0
    frontier = seen
    while max_levels is None or depth < max_levels:
        depth += 1
        found = edges.join(frontier.select(F.col("node_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node_id")).distinct()
        for known in (seen, *recent):
            found = found.join(known.select("node_id"), "node_id", "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        recent.append(frontier)
        if len(recent) == COMPACT:
            seen, recent = cut(reduce(DataFrame.unionByName, recent, seen)), []
    return reduce(DataFrame.unionByName, recent, seen).where("depth > 0")


def blast_radius(nodes: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """(file, line, depth) of all that transitively call anything of the name: each place once, with its least depth."""
    found = transitive_callers(calls, nodes.where(F.col("name") == name))
    return nodes.join(found, "node_id").groupBy("file", "line").agg(F.min("depth").alias("depth")).orderBy("file", "line")


def include_graph(nodes: DataFrame, includes: DataFrame, unresolved: DataFrame, name: str) -> DataFrame:
    """(section, value, tag) for all files of a basename: what they include, what did not resolve, and what includes them."""
    files = nodes.where((F.col("kind") == FILE) & (F.col("name") == name)).select("node_id")
    path = nodes.where(F.col("kind") == FILE).select("node_id", F.col("file").alias("value"))
    none = F.lit(None).cast("string")
    to = path.join(neighbours(includes, files, reverse=False).distinct(), "node_id", "left_semi")
    by = path.join(neighbours(includes, files).distinct(), "node_id", "left_semi")
    lost = unresolved.join(files.select(F.col("node_id").alias("includer")), "includer", "left_semi")
    tag = F.when(F.col("is_system"), "system").otherwise("external")
    parts = (
        to.select(F.lit(1).alias("_o"), F.lit("includes").alias("section"), "value", none.alias("tag")),
        lost.select(F.lit(2).alias("_o"), F.lit("unresolved").alias("section"), F.col("target").alias("value"), tag.alias("tag")),
        by.select(F.lit(3).alias("_o"), F.lit("included_by").alias("section"), "value", none.alias("tag")),
    )
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()
    return out.orderBy("_o", "value", "tag").select("section", "value", "tag")


def has_file(nodes: DataFrame, name: str) -> bool:
    return not nodes.where((F.col("kind") == FILE) & (F.col("name") == name)).isEmpty()
