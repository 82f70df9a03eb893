"""From facts by name to nodes and edges: C linkage rules as joins.

All functions take and give DataFrames, so facts of C sources and facts made of any tables resolve alike.
Hot names (a function that a third of all calls name) stay plain equi-joins, which adaptive
execution splits; priorities are a left join and a condition, never a rank over multiplied rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import basename
from ..functions.storage import cut
from ..model import DECLARATION, EXTERNAL, FILE, FUNCTION, INTERNAL, OK, TYPE_KINDS


def file_offsets(artifacts: DataFrame) -> DataFrame:
    """(path, first_id) of every good file: where its nodes begin in the order of paths.

    Paths are dealt into ranges and sorted there; only one count per range meets in one place.
    """
    size = F.lit(1) + F.size("definitions") + F.size("declarations") + F.size("types")
    files = artifacts.where((F.col("status") == OK) & F.col("bytes").isNotNull()).select("path", size.cast("long").alias("n"))
    ranged = cut(files.repartitionByRange("path").withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy("path").rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ranged.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part").select("path", (F.col("start") + F.col("within")).alias("first_id"))


def nodes_of(artifacts: DataFrame) -> DataFrame:
    """The node table: per file its File node, then definitions, declarations and types in source order; ids dense in the order of paths."""
    null_hash, named = F.lit(0).cast("long"), "name:string,line:int"

    def node(kind: Column, name: Column, line: Column, linkage: Column, hash_: Column) -> Column:
        return F.struct(kind.alias("kind"), name.alias("name"), line.cast("int").alias("line"), linkage.alias("linkage"), hash_.alias("hash"))

    ext = F.lit(EXTERNAL)
    whole = F.concat(
        F.array(node(F.lit(FILE), basename(F.col("path")), F.lit(0), ext, F.col("hash"))),
        F.transform("definitions", lambda d: node(F.lit(FUNCTION), d["name"], d["line"], F.when(d["is_static"], INTERNAL).otherwise(ext), null_hash)),
        F.transform("declarations", lambda d: node(F.lit(DECLARATION), d["name"], d["line"], ext, null_hash)),
        F.transform("types", lambda d: node(d["category"], d["name"], d["line"], ext, null_hash)),
    )
    rows = artifacts.where((F.col("status") == OK) & F.col("bytes").isNotNull()).select("path", whole.alias("_all")).join(file_offsets(artifacts), "path")
    rows = rows.select("path", "first_id", F.posexplode("_all").alias("pos", "n"))
    return rows.select((F.col("first_id") + F.col("pos")).alias("node_id"), "n.kind", "n.name", F.col("path").alias("file"), "n.line", "n.linkage", "n.hash")


def facts_of(artifacts: DataFrame, relation: str) -> DataFrame:
    """One relation's facts of good files, with column file."""
    good = artifacts.where(F.col("status") == OK)
    return good.select(F.col("path").alias("file"), F.explode(relation).alias("f")).select("file", "f.*")


def first_definitions(nodes: DataFrame) -> DataFrame:
    """(file, name, node_id): the first function of each name in each file."""
    return nodes.where(F.col("kind") == FUNCTION).groupBy("file", "name").agg(F.min("node_id").alias("node_id"))


def attributed(nodes: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """facts with src, the first function that column `by` names in the fact's file; facts without one are dropped."""
    first = first_definitions(nodes).select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("node_id").alias("src"))
    return facts.join(first, (F.col("file") == F.col("_f")) & (F.col(by) == F.col("_n"))).drop("_f", "_n")


def _local(nodes: DataFrame, sites: DataFrame) -> DataFrame:
    """sites with local: the first internal function of the callee's name in the same file, or null."""
    own = nodes.where((F.col("kind") == FUNCTION) & (F.col("linkage") == INTERNAL)).groupBy("file", "name").agg(F.min("node_id").alias("local"))
    own = own.select(F.col("file").alias("_f"), F.col("name").alias("_n"), "local")
    return sites.join(own, (F.col("file") == F.col("_f")) & (F.col("callee") == F.col("_n")), "left").drop("_f", "_n")


def _external(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("kind") == FUNCTION) & (F.col("linkage") == EXTERNAL)).select(F.col("name").alias("_e"), F.col("node_id").alias("_x"))


def call_edges(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, call_line), a row per call site and target: an internal function of the caller's file alone, else every external one."""
    sites = _local(nodes, attributed(nodes, facts, "caller").select("src", "file", "callee", "line"))
    met = sites.join(_external(nodes), (F.col("callee") == F.col("_e")) & F.col("local").isNull(), "left")
    return met.select("src", F.coalesce("local", "_x").alias("dst"), F.col("line").alias("call_line")).where(F.col("dst").isNotNull())


def call_conflicts(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(callee, caller_file, caller_line, candidates), one row per call site that has two or more external targets."""
    many = _external(nodes).groupBy("_e").agg(F.sort_array(F.collect_list("_x")).alias("candidates")).where(F.size("candidates") > 1)
    sites = _local(nodes, attributed(nodes, facts, "caller").select("src", "file", "callee", "line")).where(F.col("local").isNull())
    return sites.join(many, F.col("callee") == F.col("_e")).select("callee", F.col("file").alias("caller_file"), F.col("line").alias("caller_line"), "candidates")


def declaration_links(nodes: DataFrame) -> DataFrame:
    """(decl, def): the one external definition of the name; without external ones, the one definition there is; else none."""
    external = F.col("linkage") == EXTERNAL
    defs = nodes.where(F.col("kind") == FUNCTION).groupBy("name").agg(
        F.count_if(external).alias("n_ext"),
        F.min(F.when(external, F.col("node_id"))).alias("ext"),
        F.count(F.lit(1)).alias("n"),
        F.min("node_id").alias("any"),
    )
    pick = F.when(F.col("n_ext") == 1, F.col("ext")).when((F.col("n_ext") == 0) & (F.col("n") == 1), F.col("any"))
    defs = defs.select("name", pick.alias("def")).where(F.col("def").isNotNull())
    decls = nodes.where(F.col("kind") == DECLARATION).select(F.col("node_id").alias("decl"), "name")
    return decls.join(defs, "name").select("decl", "def")


def resolved_includes(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (file, target, is_system, line, resolved) with includer and includee; includee null if unresolved. System includes never resolve."""
    files = nodes.where(F.col("kind") == FILE)
    includer = files.select(F.col("file"), F.col("node_id").alias("includer"))
    includee = files.select(F.col("file").alias("_p"), F.col("node_id").alias("includee"))
    return facts.join(includer, "file").join(includee, (F.col("resolved") == F.col("_p")) & ~F.col("is_system"), "left").drop("_p")


def include_edges(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("includee").isNotNull()).select(F.col("includer").alias("src"), F.col("includee").alias("dst"), "line")


def unresolved(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("includee").isNull()).select("includer", "target", "is_system", "line")


def type_use_edges(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """(src, dst, line): a function to every type of the name used, in any file; repeats stay."""
    types = nodes.where(F.col("kind").isin(*TYPE_KINDS)).select(F.col("name").alias("_t"), F.col("node_id").alias("dst"))
    users = attributed(nodes, facts.withColumnRenamed("function", "_user"), "_user")
    return users.join(types, F.col("type") == F.col("_t")).select("src", "dst", "line")
