"""Scans, node table, stored index, incremental run and evaluation over C sources written from the star schema.

The sources are made in Spark: a file per brand with a function per part and a call per line item, a header
of types (nations), one of prototypes (suppliers), a header per customer with an include per order, and a
file per supplier of which three in four are no C. Each query runs the engine over them, and its DuckDB SQL
computes the same rows from the tables, without any source text but where the text itself is the matter.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import c_source
from ..functions.storage import cut, shared_dir
from ..model import OK
from ..operators import measure, resolve
from ..sources import store, trees
from ..sources.truth import truth_of
from . import evaluate
from .index import Graph, graph_of, reindex_contents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- the sources -------------------------------------------------------------
def _lines(order: list[str]) -> Column:
    """The lines of a group (text, order) in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def _pieces(lines: DataFrame, order: list[str]) -> DataFrame:
    """(path, at, text) of rows (path, text, order): lines in order, those that are equal in the first column of order, at, joined."""
    return lines.groupBy("path", F.col(order[0]).alias("at")).agg(F.when(F.count("text") > 0, _lines(order[1:])).alias("text"))


def _joined(pieces: DataFrame) -> DataFrame:
    """(path, content) of pieces: lines in order, each with its end."""
    return pieces.groupBy("path").agg(F.concat(_lines(["at"]), F.lit("\n")).alias("content"))


def functions_source(spark: SparkSession, d: str) -> DataFrame:
    """(path, at, text), a row per function: the pieces of the sources with functions."""
    part, nation = _read(spark, d, "part"), _read(spark, d, "nation")
    path = F.concat(F.lit("/code/"), F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit(".c"))
    tag = F.element_at(F.array(*[F.lit(x) for x in ("struct ", "union ", "enum ", "")]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    kind = nation.select(F.col("n_nationkey").cast("long").alias("nk"), F.concat(tag, F.regexp_replace("n_name", " ", "_")).alias("type"))
    parts = part.withColumn("nk", F.col("p_partkey") % 25).join(kind, "nk").select("p_partkey", path.alias("path"), "p_size", "type")
    name = lambda key: F.concat(F.lit("f"), F.floor(F.col(key) / 2).cast("long"))
    zero = F.lit(0).cast("long")
    static = F.when(F.col("p_size") <= 15, "static ").otherwise("")
    head = parts.select("path", "p_partkey", F.lit(0).alias("o"), zero.alias("a"), zero.alias("b"), F.concat(static, F.lit("int "), name("p_partkey"), F.lit("("), F.col("type"), F.lit(" *p) {")).alias("text"))
    foot = parts.select("path", "p_partkey", F.lit(2).alias("o"), zero.alias("a"), zero.alias("b"), F.lit("}").alias("text"))
    items = _read(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", "l_orderkey", "l_linenumber")
    calls = items.join(parts.select("p_partkey", "path"), "p_partkey")
    calls = calls.select("path", "p_partkey", F.lit(1).alias("o"), F.col("l_orderkey").cast("long").alias("a"), F.col("l_linenumber").cast("long").alias("b"), F.concat(F.lit("  "), name("l_suppkey"), F.lit("(1);")).alias("text"))
    first = parts.select("path").distinct().select("path", F.lit(-1).cast("long").alias("p_partkey"), F.lit(0).alias("o"), zero.alias("a"), zero.alias("b"), F.lit('#include "types.h"').alias("text"))
    return _pieces(first.unionByName(head).unionByName(calls).unionByName(foot), ["p_partkey", "o", "a", "b"])


def headers_source(spark: SparkSession, d: str) -> DataFrame:
    """(path, at, text): the pieces of the headers."""
    nation, name = _read(spark, d, "nation"), F.regexp_replace("n_name", " ", "_")
    body = [F.concat(F.lit("struct "), name, F.lit(" { int v; };")), F.concat(F.lit("union "), name, F.lit(" { int v; };")), F.concat(F.lit("enum "), name, F.lit(" { "), name, F.lit("_A };")), F.concat(F.lit("typedef int "), name, F.lit(";"))]
    text = F.element_at(F.array(*body), (F.col("n_nationkey") % 4 + 1).cast("int"))
    types = nation.select(F.lit("/code/types.h").alias("path"), F.col("n_nationkey").cast("long").alias("k"), text.alias("text"))
    decls = _read(spark, d, "supplier").select(F.lit("/code/decls.h").alias("path"), F.col("s_suppkey").cast("long").alias("k"), F.concat(F.lit("int f"), F.floor(F.col("s_suppkey") / 2).cast("long"), F.lit("(int a);")).alias("text"))
    customer = _read(spark, d, "customer").select("c_custkey", F.concat(F.lit("/code/n"), F.col("c_nationkey"), F.lit("/c"), F.col("c_custkey"), F.lit(".h")).alias("path"))
    n = customer.agg(F.count(F.lit(1)).alias("n"))
    key = F.col("o_orderkey")
    local = F.concat(F.lit('#include "../n'), key % 25, F.lit("/c"), (key * 7) % (F.col("n") + F.floor(F.col("n") / 4)), F.lit('.h"'))
    system = F.concat(F.lit("#include <sys"), key % 10, F.lit(".h>"))
    orders = _read(spark, d, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).crossJoin(F.broadcast(n))  # one row
    lines = orders.select("path", key.cast("long").alias("k"), F.when(F.col("o_orderpriority") == "1-URGENT", system).otherwise(local).alias("text"))
    lines = lines.unionByName(customer.select("path", F.lit(-1).cast("long").alias("k"), F.lit("/* a customer */").alias("text")))
    return _pieces(types.unionByName(decls).unionByName(lines), ["k"])


def broken_source(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    shapes = [F.concat(F.lit("int a"), k, F.lit("(void) { return 1; }")), F.concat(F.lit("int b"), k, F.lit("(void) { return 1 }")), F.concat(F.lit("int x"), k, F.lit(" = ;")), F.lit("@@ $%")]
    return _read(spark, d, "supplier").select(F.concat(F.lit("/code/s/s"), k, F.lit(".c")).alias("path"), F.concat(F.element_at(F.array(*shapes), (k % 4 + 1).cast("int")), F.lit("\n")).alias("content"))


def _files(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", F.substring("path", 7, 10_000).alias("rel"), F.col("content").cast("binary").alias("content"))


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(path, rel, content) of every file."""
    return _files(_joined(functions_source(spark, d)), _joined(headers_source(spark, d)), broken_source(spark, d))


def parsed(spark: SparkSession, d: str, *parts, keep: Collection[str] = trees.RELATIONS) -> DataFrame:
    """Artifacts of the sources that parts make, with the facts of the relations in keep. A file of very many lines is never joined in Spark."""
    whole = [p(spark, d) for p in parts if p is broken_source]
    pieces = [p(spark, d) for p in parts if p is not broken_source]
    found = [trees.parse_contents(_files(x), keep) for x in whole]
    if pieces:
        rows = reduce(DataFrame.unionByName, pieces)
        found.append(trees.parse_pieces(rows.withColumn("rel", F.substring("path", 7, 10_000)), keep))
    return reduce(DataFrame.unionByName, found)


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    return cut(parsed(spark, d, functions_source, headers_source, broken_source))


def facts(spark: SparkSession, d: str, relation: str, *parts) -> DataFrame:
    return resolve.facts_of(parsed(spark, d, *parts, keep=(relation,)), relation)


# -- the same in SQL -----------------------------------------------------------
_FUNCTIONS = """types AS (SELECT n_nationkey AS nk, replace(n_name, ' ', '_') AS type, ['Struct', 'Union', 'Enum', 'Typedef'][n_nationkey % 4 + 1] AS category,
    row_number() OVER (ORDER BY n_nationkey) AS line FROM nation),
  blocks AS (SELECT p_partkey AS k, '/code/' || replace(lower(p_brand), '#', '') || '.c' AS file, 'f' || (p_partkey // 2) AS name, p_size <= 15 AS is_static, type,
    coalesce(n, 0) AS n FROM part JOIN types ON nk = p_partkey % 25 LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey),
  functions AS (SELECT *, (2 + coalesce(sum(n + 2) OVER (PARTITION BY file ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line FROM blocks),
  items AS (SELECT file, f.name AS caller, 'f' || (l_suppkey // 2) AS callee,
    (f.line + row_number() OVER (PARTITION BY f.k ORDER BY l_orderkey, l_linenumber, 'f' || (l_suppkey // 2) || '(1);'))::INT AS line FROM lineitem JOIN functions f ON f.k = l_partkey),
  decls AS (SELECT 'f' || (s_suppkey // 2) AS name, '/code/decls.h' AS file, (row_number() OVER (ORDER BY s_suppkey))::INT AS line FROM supplier),
  good AS (SELECT 'a' || s_suppkey AS name, '/code/s/s' || s_suppkey || '.c' AS file, 1 AS line FROM supplier WHERE s_suppkey % 4 = 0)"""
_HEADERS = """customers AS (SELECT c_custkey, '/code/n' || c_nationkey || '/c' || c_custkey || '.h' AS file FROM customer),
  directives AS (SELECT file, o_orderpriority = '1-URGENT' AS is_system, o_orderkey AS k, 'n' || (o_orderkey % 25) || '/c' || ((o_orderkey * 7) % (n + n // 4)) || '.h' AS place,
    (1 + row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey))::INT AS line FROM orders JOIN customers ON o_custkey = c_custkey, (SELECT count(*) AS n FROM customer))"""
_NODES = f"""{_FUNCTIONS}, {_HEADERS},
  files AS (SELECT DISTINCT file FROM functions UNION SELECT '/code/types.h' UNION SELECT '/code/decls.h' UNION SELECT file FROM customers UNION SELECT file FROM good),
  every AS (SELECT file, 0 AS o, 0 AS line, 'File' AS kind, regexp_extract(file, '[^/]*$') AS name, 'External' AS linkage FROM files
    UNION ALL SELECT file, 1, line, 'Function', name, CASE WHEN is_static THEN 'Internal' ELSE 'External' END FROM functions
    UNION ALL SELECT file, 1, line, 'Function', name, 'External' FROM good UNION ALL SELECT file, 2, line, 'FunctionDecl', name, 'External' FROM decls
    UNION ALL SELECT '/code/types.h', 3, line::INT, category, type, 'External' FROM types),
  nodes AS (SELECT row_number() OVER (ORDER BY file, o, line) - 1 AS node_id, kind, name, file, line, linkage FROM every)"""
_EDGES = f"""{_NODES},
  funcs AS (SELECT * FROM nodes WHERE kind = 'Function'),
  first_def AS (SELECT file, name, min(node_id) AS node_id FROM funcs GROUP BY file, name),
  own AS (SELECT file, name, min(node_id) AS node_id FROM funcs WHERE linkage = 'Internal' GROUP BY file, name),
  sites AS (SELECT s.node_id AS src, i.file, callee, i.line, o.node_id AS local FROM items i JOIN first_def s ON s.file = i.file AND s.name = i.caller LEFT JOIN own o ON o.file = i.file AND o.name = callee),
  ext AS (SELECT node_id, name FROM funcs WHERE linkage = 'External'),
  calls AS (SELECT src, local AS dst, line AS call_line FROM sites WHERE local IS NOT NULL UNION ALL SELECT src, e.node_id, line FROM sites JOIN ext e ON e.name = callee WHERE local IS NULL),
  at_file AS (SELECT file, node_id FROM nodes WHERE kind = 'File'),
  resolved AS (SELECT a.node_id AS includer, b.node_id AS includee, x.line FROM directives x JOIN at_file a USING (file) LEFT JOIN at_file b ON b.file = '/code/' || place AND NOT is_system
    UNION ALL SELECT a.node_id, b.node_id, 1 FROM at_file a, at_file b WHERE b.file = '/code/types.h' AND a.file IN (SELECT file FROM functions)),
  uses AS (SELECT s.node_id AS src, t.node_id AS dst, f.line FROM functions f JOIN first_def s ON s.file = f.file AND s.name = f.name JOIN nodes t ON t.name = f.type AND t.kind IN ('Struct', 'Union', 'Enum', 'Typedef')),
  by_name AS (SELECT name, count(*) FILTER (linkage = 'External') AS n_ext, count(*) AS n FROM funcs GROUP BY name),
  links AS (SELECT d.node_id FROM nodes d JOIN by_name USING (name) WHERE d.kind = 'FunctionDecl' AND (n_ext = 1 OR n_ext = 0 AND n = 1)),
  conflicts AS (SELECT 1 AS c FROM sites JOIN by_name ON name = callee WHERE local IS NULL AND n_ext > 1),
  skipped AS (SELECT 1 AS c FROM supplier WHERE s_suppkey % 4 <> 0)"""
_COUNTS = """SELECT 'nodes' AS relation, count(*) AS n FROM nodes UNION ALL SELECT 'calls', count(*) FROM calls UNION ALL SELECT 'includes', count(includee) FROM resolved
  UNION ALL SELECT 'uses_type', count(*) FROM uses UNION ALL SELECT 'declares', count(*) FROM links UNION ALL SELECT 'unresolved_includes', count(*) FROM resolved WHERE includee IS NULL
  UNION ALL SELECT 'diagnostics', count(*) FROM conflicts UNION ALL SELECT 'skipped_files', count(*) FROM skipped"""


# -- scans ---------------------------------------------------------------------
@query(f"WITH {_FUNCTIONS} SELECT file, name, line, is_static FROM functions UNION ALL SELECT file, name, line, false FROM good")
def scan_definitions(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "definitions", functions_source, broken_source)


@query(f"WITH {_FUNCTIONS} SELECT file, name, line FROM decls")
def scan_declarations(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "declarations", functions_source, headers_source)


@query(f"WITH {_FUNCTIONS} SELECT file, caller, callee, line FROM items")
def scan_calls(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "calls", functions_source)


@query(f"""WITH {_HEADERS} SELECT file, CASE WHEN is_system THEN 'sys' || (k % 10) || '.h' ELSE '../' || place END AS target, is_system, line,
  CASE WHEN NOT is_system THEN '/code/' || place END AS resolved FROM directives""")
def scan_includes(spark: SparkSession, d: str) -> DataFrame:
    """Includes with the normal path that each local one points to."""
    return facts(spark, d, "includes", headers_source)


@query(f"WITH {_FUNCTIONS} SELECT '/code/types.h' AS file, type AS name, line::INT AS line, category FROM types")
def scan_types(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "types", functions_source, headers_source)


@query(f"WITH {_FUNCTIONS} SELECT file, name AS \"function\", type, line FROM functions")
def scan_type_uses(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "type_uses", functions_source)


@query("SELECT '/code/s/s' || s_suppkey || '.c' AS path, 'syntax error' AS reason FROM supplier WHERE s_suppkey % 4 <> 0")
def scan_skipped(spark: SparkSession, d: str) -> DataFrame:
    found = parsed(spark, d, broken_source, keep=())
    return found.where(F.col("status") != OK).select("path", F.col("status").alias("reason"))


_FNV = """list_reduce(list_transform(range(0, length(h) // 2), lambda j: (instr('0123456789ABCDEF', h[2 * j + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * j + 2]) - 1)::HUGEINT[],
    lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616, 1469598103934665603::HUGEINT)"""


@query(
    f"""WITH {_HEADERS},
  texts AS (SELECT '/code/types.h' AS path, string_agg(['struct ' || t || ' {{ int v; }};', 'union ' || t || ' {{ int v; }};', 'enum ' || t || ' {{ ' || t || '_A }};', 'typedef int ' || t || ';'][n_nationkey % 4 + 1] || chr(10), '' ORDER BY n_nationkey) AS content
      FROM (SELECT n_nationkey, replace(n_name, ' ', '_') AS t FROM nation)
    UNION ALL SELECT '/code/decls.h', string_agg('int f' || (s_suppkey // 2) || '(int a);' || chr(10), '' ORDER BY s_suppkey) FROM supplier
    UNION ALL SELECT c.file, '/* a customer */' || chr(10) || coalesce(string_agg(CASE WHEN is_system THEN '#include <sys' || (k % 10) || '.h>' ELSE '#include "../' || place || '"' END || chr(10), '' ORDER BY line), '')
      FROM customers c LEFT JOIN directives USING (file) GROUP BY c.file),
  hashed AS (SELECT path, content, {_FNV} AS u FROM (SELECT path, content, hex(encode(content)) AS h FROM texts))
SELECT path, substr(path, 7) AS rel, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS hash, strlen(content)::BIGINT AS bytes,
  (length(content) - length(replace(content, chr(10), '')))::BIGINT AS lines FROM hashed"""
)
def scan_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Path below the root, content hash and size of every header."""
    return trees.files_of(parsed(spark, d, headers_source, keep=())).select("path", "rel", "hash", "bytes", "lines")


@query("SELECT doc_id, source || '/d' || doc_id || ['.c', '.h', '.C', '.cc', '.hpp', 'c', '.c.o'][doc_id % 7 + 1] AS path FROM documents WHERE doc_id % 7 < 2")
def c_sources(spark: SparkSession, d: str) -> DataFrame:
    """Names that end in .c or .h, of names of seven endings."""
    ends = F.array(*[F.lit(x) for x in (".c", ".h", ".C", ".cc", ".hpp", "c", ".c.o")])
    path = F.concat("source", F.lit("/d"), "doc_id", F.element_at(ends, (F.col("doc_id") % 7 + 1).cast("int")))
    return _read(spark, d, "documents").select("doc_id", path.alias("path")).where(c_source(F.col("path")))


@query(f"WITH {_NODES}, sizes AS (SELECT n_nationkey FROM nation) SELECT count(*) AS files, sum(line) ::BIGINT AS lines FROM (SELECT file, max(line) AS line FROM ({' UNION ALL '.join(['SELECT file, line + n + 1 AS line FROM functions'])}) GROUP BY file)")
def input_size(spark: SparkSession, d: str) -> DataFrame:
    """Files and lines of the function sources."""
    return trees.input_size(parsed(spark, d, functions_source, keep=())).select("files", F.col("lines").cast("long").alias("lines"))


# -- nodes, index, incremental run ----------------------------------------------
@query(f"WITH {_NODES} SELECT node_id, kind, name, file, line, linkage FROM nodes")
def node_table(spark: SparkSession, d: str) -> DataFrame:
    """The merged node table with its dense ids."""
    return resolve.nodes_of(artifacts(spark, d)).drop("hash")


@query(f"WITH {_NODES}, wanted AS (SELECT min(node_id) AS id FROM nodes WHERE kind = 'FunctionDecl') SELECT node_id, kind, name, file, line FROM nodes JOIN wanted ON node_id = id")
def node_by_id(spark: SparkSession, d: str) -> DataFrame:
    graph = graph_of(artifacts(spark, d))
    wanted = graph.nodes.where("kind = 'FunctionDecl'").agg(F.min("node_id").alias("id")).first()["id"]
    return graph.node(-1 if wanted is None else wanted).select("node_id", "kind", "name", "file", "line")


@query(f"WITH {_EDGES} SELECT src, dst, call_line FROM calls")
def index_calls(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(artifacts(spark, d)).calls


@query(f"WITH {_EDGES} SELECT src, dst, line FROM uses")
def index_type_uses(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(artifacts(spark, d)).uses_type


@query(f"WITH {_EDGES} SELECT includer AS src, includee AS dst, line FROM resolved WHERE includee IS NOT NULL")
def index_includes(spark: SparkSession, d: str) -> DataFrame:
    return graph_of(artifacts(spark, d)).includes


def _counts(graph: Graph) -> DataFrame:
    out = None
    for name in graph.relations:
        one = getattr(graph, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_EDGES} {_COUNTS}")
def index_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every relation of the index."""
    return _counts(graph_of(artifacts(spark, d)))


def _stored(spark: SparkSession, d: str) -> Graph:
    path = f"{shared_dir(spark).rstrip('/')}/index-of-tables"
    graph_of(artifacts(spark, d)).save(path)
    return Graph(*store.load(spark, path), stored=True)


@query(f"WITH {_EDGES} {_COUNTS}")
def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """The same of the index as written and loaded again."""
    return _counts(_stored(spark, d))


@query(f"WITH {_EDGES}, part_of AS (SELECT node_id FROM nodes WHERE kind = 'File') SELECT count(*) FILTER (kind = 'File') AS files, count(*) AS nodes, ((SELECT count(*) FROM calls) + (SELECT count(includee) FROM resolved) + (SELECT count(*) FROM uses) + (SELECT count(*) FROM links))::BIGINT AS edges, (SELECT count(*) FROM skipped) AS skipped FROM nodes")
def index_totals(spark: SparkSession, d: str) -> DataFrame:
    """The index command's summary."""
    return graph_of(artifacts(spark, d)).summary().select("files", "nodes", F.col("edges").cast("long").alias("edges"), "skipped")


@query(f"WITH {_EDGES}, s AS (SELECT (SELECT count(*) FROM files) + (SELECT count(*) FROM skipped) AS n, (SELECT count(*) FROM customers) AS old) SELECT n - old + (SELECT count(*) FROM customers WHERE c_custkey % 3 = 0) AS files_parsed, old - (SELECT count(*) FROM customers WHERE c_custkey % 3 = 0) AS files_reused, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM calls) AS calls FROM s")
def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """An index made again where the customers' headers were known before, every third of them with other contents."""
    key = F.regexp_extract("path", r"/c(\d+)\.h$", 1).try_cast("long")
    known = _files(_joined(headers_source(spark, d))).where(key.isNotNull())
    old = known.withColumn("content", F.when(key % 3 == 0, F.lit("int old;\n").cast("binary")).otherwise(F.col("content")))
    done = reindex_contents(sources(spark, d), cut(trees.parse_contents(old)))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = n(done.graph.nodes, "nodes").crossJoin(n(done.graph.calls, "calls"))  # one row each
    return counts.select(F.lit(done.files_parsed).cast("long").alias("files_parsed"), F.lit(done.files_reused).cast("long").alias("files_reused"), "nodes", "calls")


# -- evaluation -----------------------------------------------------------------
_TRUTH = f"""{_EDGES},
  asked AS (SELECT DISTINCT name AS symbol FROM decls),
  rel AS (SELECT node_id, kind, name, substr(file, 7) AS file, line FROM nodes),
  expected AS (SELECT 'find-definition' AS query, name AS symbol, substr(file, 7) AS file, line FROM functions WHERE name IN (SELECT symbol FROM asked) AND k % 3 <> 0)"""


def _truth_lines(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth lines: both queries for every prototype's name; of definitions two in three places are named."""
    at = facts(spark, d, "definitions", functions_source)
    part = _read(spark, d, "part").select("p_partkey", F.concat(F.lit("f"), F.floor(F.col("p_partkey") / 2).cast("long")).alias("name"), F.concat(F.lit("/code/"), F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit(".c")).alias("file"))
    nth = F.row_number().over(W.partitionBy("file", "name").orderBy("line"))
    keys = part.withColumn("nth", F.row_number().over(W.partitionBy("file", "name").orderBy("p_partkey")))
    places = at.withColumn("nth", nth).join(keys, ["file", "name", "nth"]).where("p_partkey % 3 <> 0")
    places = places.select(F.col("name").alias("symbol"), F.concat_ws(":", F.substring("file", 7, 10_000), "line").alias("place"))
    asked = _read(spark, d, "supplier").select(F.concat(F.lit("f"), F.floor(F.col("s_suppkey") / 2).cast("long")).alias("symbol")).distinct()
    named = asked.join(places, "symbol", "left").groupBy("symbol").agg(F.array_join(F.array_sort(F.collect_list("place")), " ").alias("places"))
    find = named.select(F.concat_ws(" ", F.lit("find-definition"), "symbol", "places").alias("value"))
    return find.unionByName(asked.select(F.concat_ws(" ", F.lit("who-calls"), "symbol").alias("value"))).unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string"))


@query(f"WITH {_TRUTH} SELECT query, symbol, file, line FROM expected")
def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    """Expected places, read from lines of text."""
    return truth_of(_truth_lines(spark, d))[1]


@query(
    f"""WITH {_TRUTH},
  answers AS (SELECT DISTINCT 'find-definition' AS query, name AS symbol, file, line FROM rel WHERE kind = 'Function' AND name IN (SELECT symbol FROM asked)
    UNION SELECT DISTINCT 'who-calls', t.name, s.file, call_line FROM calls JOIN rel t ON t.node_id = dst JOIN rel s ON s.node_id = src WHERE t.name IN (SELECT symbol FROM asked)),
  queries AS (SELECT 'find-definition' AS query, symbol FROM asked UNION ALL SELECT 'who-calls', symbol FROM asked),
  counted AS (SELECT q.query, q.symbol, (SELECT count(*) FROM expected e WHERE e.query = q.query AND e.symbol = q.symbol) AS relevant, (SELECT count(*) FROM answers a WHERE a.query = q.query AND a.symbol = q.symbol) AS retrieved,
    (SELECT count(*) FROM answers a JOIN expected e USING (query, symbol, file, line) WHERE a.query = q.query AND a.symbol = q.symbol) AS true_positives FROM queries q)
SELECT query, symbol, relevant, retrieved, true_positives, round(CASE WHEN retrieved = 0 THEN 1.0::DOUBLE ELSE true_positives / retrieved END, 9) AS precision,
  round(CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE true_positives / relevant END, 9) AS recall FROM counted"""
)
def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The graph's answers to every query of the ground truth, scored."""
    queries, expected = truth_of(cut(_truth_lines(spark, d)))
    found = artifacts(spark, d)
    answers = evaluate.graph_answers(graph_of(found), queries, trees.files_of(found).select("path", "rel"))
    scored = measure.scores(expected, answers, queries, ["query", "symbol"])
    return scored.select("query", "symbol", "relevant", "retrieved", "true_positives", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def ranked(df: DataFrame, *columns: str) -> DataFrame:
    """df in the order that its operator gave, with that order as column rank (from 1). For small answers: one window over all rows."""
    at = df.select(*columns, F.monotonically_increasing_id().alias("_at"))
    return at.withColumn("rank", F.row_number().over(W.orderBy("_at"))).drop("_at")


@query(f"WITH {_FUNCTIONS}, best AS (SELECT name FROM functions GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) SELECT file, line, (row_number() OVER (ORDER BY file, line))::INT AS rank FROM functions JOIN best USING (name)")
def sorted_places(spark: SparkSession, d: str) -> DataFrame:
    """The definitions of the name that most functions have, in the order of the answer."""
    graph = graph_of(artifacts(spark, d))
    name = graph.nodes.where("kind = 'Function'").groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()
    return ranked(graph.find_definition(name["name"] if name else ""), "file", "line")


@query("SELECT source, count(*) FILTER (lang = 'en') AS part, count(*) AS whole, round(CASE WHEN count(*) FILTER (lang = 'de') = 0 THEN 0.0::DOUBLE ELSE count(*) FILTER (lang = 'en') / count(*) FILTER (lang = 'de') END, 9) AS share FROM documents GROUP BY source")
def ratios(spark: SparkSession, d: str) -> DataFrame:
    n: Column = F.count_if(F.col("lang") == "de")
    counts = _read(spark, d, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("part"), F.count(F.lit(1)).alias("whole"), n.alias("other"))
    return counts.select("source", "part", "whole", F.round(measure.ratio(F.col("part"), F.col("other")), 9).alias("share"))
