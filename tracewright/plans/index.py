"""Indexing: artifacts to a graph, from scratch or from what is unchanged."""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_hash
from ..functions.storage import cut
from ..model import OK, RELATIONS
from ..operators import measure, navigate, resolve
from ..sources import store, trees


@dataclass
class Graph:
    """A code graph: the relations of model.RELATIONS as DataFrames.

    A relation that is still a plan is written to the shared folder when it is first asked for, so
    that later questions read it. stored: the relations are tables already.
    """

    relations: dict[str, DataFrame]
    artifacts: DataFrame | None = None
    stored: bool = False

    def __getattr__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            raise AttributeError(name)
        if not self.stored and name not in self.__dict__.setdefault("_cut", set()):
            self.relations[name] = cut(self.relations[name])
            self._cut.add(name)
        return self.relations[name]

    # point lookups and one hop
    def nodes_named(self, name: str) -> DataFrame:
        return navigate.nodes_named(self.nodes, name)

    def node(self, node_id: int) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def size(self) -> int:
        return self.nodes.count()

    def callers_of(self, ids: DataFrame) -> DataFrame:
        return navigate.neighbours(self.calls, ids)

    def callees_of(self, ids: DataFrame) -> DataFrame:
        return navigate.neighbours(self.calls, ids, reverse=False)

    def includes_of(self, ids: DataFrame) -> DataFrame:
        return navigate.neighbours(self.includes, ids, reverse=False)

    def included_by(self, ids: DataFrame) -> DataFrame:
        return navigate.neighbours(self.includes, ids)

    def users_of(self, ids: DataFrame) -> DataFrame:
        return navigate.neighbours(self.uses_type, ids)

    def definition_of(self, ids: DataFrame) -> DataFrame:
        return navigate.definition_of(self.declares, ids)

    def transitive_callers(self, ids: DataFrame) -> DataFrame:
        return navigate.transitive_callers(self.calls, ids)

    # commands
    def find_definition(self, name: str) -> DataFrame:
        return navigate.find_definition(self.nodes, name)

    def find_declarations(self, name: str) -> DataFrame:
        return navigate.find_declarations(self.nodes, name)

    def who_calls(self, name: str) -> DataFrame:
        return navigate.who_calls(self.nodes, self.calls, name)

    def call_sites(self, name: str) -> DataFrame:
        return navigate.call_sites(self.nodes, self.calls, name)

    def blast_radius(self, name: str) -> DataFrame:
        return navigate.blast_radius(self.nodes, self.calls, name)

    def who_uses_type(self, name: str) -> DataFrame:
        return navigate.who_uses_type(self.nodes, self.uses_type, name)

    def include_graph(self, name: str) -> DataFrame:
        if not navigate.has_file(self.nodes, name):
            raise LookupError(f"no indexed file is named {name}")
        return navigate.include_graph(self.nodes, self.includes, self.unresolved_includes, name)

    def edge_count(self) -> int:
        return measure.edge_count(self.declares, self.calls, self.includes, self.uses_type).first()["edges"] or 0

    def summary(self) -> DataFrame:
        return measure.index_summary(self.nodes, [self.declares, self.calls, self.includes, self.uses_type], self.skipped_files)

    def save(self, path: str) -> None:
        store.save(self.relations, path, self.artifacts)

    def report_diagnostics(self, to=None) -> None:
        """Warnings on stderr: skipped files, and calls whose name has several external definitions."""
        to = to or sys.stderr
        for r in self.skipped_files.orderBy("path").toLocalIterator():
            print(f"warning: skipped {r.path}: {r.reason}", file=to)
        for r in self.diagnostics.orderBy("caller_file", "caller_line", "callee").toLocalIterator():
            print(f"warning: {r.caller_file}:{r.caller_line}: {r.callee} has {len(r.candidates)} external definitions", file=to)


def graph_of(artifacts: DataFrame) -> Graph:
    """Merge and resolve. artifacts must be cheap to read again: cut them after parsing."""
    facts = {k: resolve.facts_of(artifacts, k) for k in ("calls", "includes", "type_uses")}
    nodes = cut(resolve.nodes_of(artifacts))
    includes = resolve.resolved_includes(nodes, facts["includes"])
    skipped = artifacts.where(F.col("status") != OK).select("path", F.col("status").alias("reason"))
    relations = {
        "nodes": nodes,
        "calls": resolve.call_edges(nodes, facts["calls"]),
        "includes": resolve.include_edges(includes),
        "uses_type": resolve.type_use_edges(nodes, facts["type_uses"]),
        "declares": resolve.declaration_links(nodes),
        "unresolved_includes": resolve.unresolved(includes),
        "diagnostics": resolve.call_conflicts(nodes, facts["calls"]),
        "skipped_files": skipped,
    }
    return Graph(relations, artifacts)


def build_index(spark: SparkSession, root: str) -> Graph:
    """The graph of a tree: a mounted folder, or a URI (scheme://...) that only Spark reads."""
    if "://" in root:
        return index_contents(trees.contents_table(spark, root))
    return graph_of(cut(trees.parse(trees.paths_table(spark, root))))


def index_contents(files: DataFrame) -> Graph:
    """The graph of files given with their contents (path, rel, content)."""
    return graph_of(cut(trees.parse_contents(files)))


@dataclass
class Reindexed:
    graph: Graph
    files_parsed: int
    files_reused: int


def hashes(paths: DataFrame) -> DataFrame:
    """paths with the hash of each file's bytes; null where it can't be read."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data = [trees._read(p) for p in b.column("path").to_pylist()]
            values = pa.array([None if d is None else content_hash(d) for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("rel"), values], ["path", "rel", "hash"])

    return paths.mapInArrow(run, "path string, rel string, hash long")


def content_hashes(files: DataFrame) -> DataFrame:
    """(path, rel, hash) of files given with their contents."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values = pa.array([None if d is None else content_hash(d) for d in b.column("content").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("rel"), values], ["path", "rel", "hash"])

    return files.select("path", "rel", F.col("content").cast("binary")).mapInArrow(run, "path string, rel string, hash long")


def split_unchanged(current: DataFrame, prior: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts to reuse, paths to parse): a file is unchanged if its path and hash are those of a good prior artifact."""
    good = prior.where(F.col("status") == OK)
    reused = good.join(current.select("path", "hash"), ["path", "hash"], "left_semi")
    return reused, current.join(good.select("path", "hash"), ["path", "hash"], "left_anti")


def reindex(spark: SparkSession, root: str, prior: DataFrame) -> Reindexed:
    """As build_index, but files unchanged since prior are not parsed again. Merging and resolving start anew, so the result is the same."""
    if "://" in root:
        return reindex_contents(trees.contents_table(spark, root), prior)
    current = cut(hashes(trees.paths_table(spark, root)))
    return _merged(current, prior, trees.parse)


def reindex_contents(files: DataFrame, prior: DataFrame) -> Reindexed:
    """As reindex, of files given with their contents (path, rel, content)."""
    files = cut(files.select("path", "rel", "content"))
    return _merged(cut(content_hashes(files)), prior, lambda changed: trees.parse_contents(files.join(changed.select("path"), "path", "left_semi")))


def _merged(current: DataFrame, prior: DataFrame, parse) -> Reindexed:
    reused, changed = split_unchanged(current, prior)
    reused = cut(reused)
    parsed = cut(parse(changed.select("path", "rel")))
    graph = graph_of(cut(reused.select(*prior.columns).unionByName(parsed)))
    return Reindexed(graph, trees.files_of(parsed).count(), trees.files_of(reused).count())


def load_or_index(spark: SparkSession, root: str, index_path: str | None = None, refresh: bool = False) -> Graph:
    """The stored index if there is one that can be read, else one made of the sources. Stored indexes are not held against the sources; refresh=True makes a new one."""
    path = index_path or f"{root.rstrip('/')}/{store.DEFAULT_NAME}"
    if not refresh:
        try:
            return Graph(*store.load(spark, path), stored=True)
        except store.NoIndexError:
            pass
        except store.IndexFormatError as e:
            print(f"warning: {e}; indexing the sources", file=sys.stderr)
    return build_index(spark, root)
