"""The graph operators over plain tables: facts derived from the star schema, and one query per operator.

Definitions come from parts, call sites from line items, declarations from suppliers, includes from
orders, type uses from customers. Each query has DuckDB SQL beside it that computes the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DECLARATION, EXTERNAL, FILE, FUNCTION, INTERNAL, OK
from ..operators import measure, navigate, resolve, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- facts ------------------------------------------------------------------
NODE = ["node_id", "kind", "name", "file", "line", "linkage"]


def definitions(spark: SparkSession, d: str, long_names: bool = False) -> DataFrame:
    """A function node per part; its brand is its file. long_names: the brand is part of the name too."""
    name = F.concat_ws(":", "p_name", "p_type", *(["p_brand"] if long_names else []))
    linkage = F.when(F.col("p_size") <= 15, INTERNAL).otherwise(EXTERNAL)
    return _read(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.lit(FUNCTION).alias("kind"), name.alias("name"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), linkage.alias("linkage"))


def call_facts(spark: SparkSession, d: str) -> DataFrame:
    """(file, caller, callee, line) of each distinct line item."""
    items = _read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    defs = definitions(spark, d).select("node_id", "name", "file")
    caller = defs.select(F.col("node_id").alias("l_partkey"), F.col("name").alias("caller"), "file")
    callee = defs.select(F.col("node_id").alias("l_suppkey"), F.col("name").alias("callee"))
    return items.join(caller, "l_partkey").join(callee, "l_suppkey").select("file", "caller", "callee", F.col("l_orderkey").alias("line")).distinct()


def calls(spark: SparkSession, d: str) -> DataFrame:
    return resolve.call_edges(definitions(spark, d), call_facts(spark, d))


def declared(spark: SparkSession, d: str) -> DataFrame:
    """Definitions with long names, and a declaration per supplier of the part of its number; their ids are negative."""
    defs = definitions(spark, d, long_names=True)
    keys = _read(spark, d, "supplier").select("s_suppkey").join(defs, F.col("s_suppkey") == F.col("node_id"))
    decls = keys.select((-1 - F.col("s_suppkey")).alias("node_id"), F.lit(DECLARATION).alias("kind"), "name", F.lit("decls.h").alias("file"), F.col("s_suppkey").alias("line"), F.lit(EXTERNAL).alias("linkage"))
    return defs.unionByName(decls)


def include_files(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/n"), F.col("c_nationkey"), F.lit("/c"), F.col("c_custkey"), F.lit(".h"))
    return _read(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.lit(FILE).alias("kind"), F.substring_index(path, "/", -1).alias("name"), path.alias("file"), F.lit(0).cast("long").alias("line"), F.lit(EXTERNAL).alias("linkage"))


def include_facts(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "customer").agg(F.count(F.lit(1)).alias("n"))
    files = include_files(spark, d).select(F.col("node_id").alias("o_custkey"), "file")
    o = _read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").crossJoin(F.broadcast(n))  # one row
    where = F.concat(F.lit("n"), F.col("o_orderkey") % 25, F.lit("/c"), (F.col("o_orderkey") * 7) % (F.col("n") + F.floor(F.col("n") / 4)), F.lit(".h"))
    return o.join(files, "o_custkey").select("file", F.concat(F.lit("../"), where).alias("target"), (F.col("o_orderpriority") == "1-URGENT").alias("is_system"), F.col("o_orderkey").alias("line"), F.concat(F.lit("/"), where).alias("resolved"))


def includes(spark: SparkSession, d: str) -> DataFrame:
    return resolve.resolved_includes(include_files(spark, d), include_facts(spark, d))


def typed(spark: SparkSession, d: str) -> DataFrame:
    """Definitions, and a type per nation."""
    types = _read(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("node_id"), F.lit("Struct").alias("kind"), F.col("n_name").alias("name"), F.lit("types.h").alias("file"), F.col("n_nationkey").cast("long").alias("line"), F.lit(EXTERNAL).alias("linkage"))
    return definitions(spark, d).unionByName(types)


def type_use_facts(spark: SparkSession, d: str) -> DataFrame:
    n = _read(spark, d, "part").agg(F.count(F.lit(1)).alias("n"))
    defs = definitions(spark, d).select(F.col("node_id").alias("k"), "file", F.col("name").alias("function"))
    nation = _read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("type"))
    c = _read(spark, d, "customer").crossJoin(F.broadcast(n)).withColumn("k", F.col("c_custkey") % F.col("n"))  # one row
    return c.join(defs, "k").join(nation, "c_nationkey").select("file", "function", "type", F.col("c_custkey").alias("line"))


# -- the same facts in SQL ---------------------------------------------------
_DEFS = "defs AS (SELECT p_partkey AS node_id, p_name || ':' || p_type AS name, p_brand AS file, p_partkey AS line, p_size <= 15 AS internal FROM part)"
_SITES = f"""{_DEFS},
facts AS (SELECT DISTINCT l_orderkey AS line, c.file AS file, c.name AS caller, d.name AS callee FROM lineitem JOIN defs c ON l_partkey = c.node_id JOIN defs d ON l_suppkey = d.node_id),
first_def AS (SELECT file, name, min(node_id) AS node_id FROM defs GROUP BY file, name),
own AS (SELECT file, name, min(node_id) AS node_id FROM defs WHERE internal GROUP BY file, name),
sites AS (SELECT s.node_id AS src, f.file, f.callee, f.line, o.node_id AS local FROM facts f JOIN first_def s ON s.file = f.file AND s.name = f.caller LEFT JOIN own o ON o.file = f.file AND o.name = f.callee),
ext AS (SELECT node_id, name FROM defs WHERE NOT internal)"""
_CALLS = f"""{_SITES},
calls AS (SELECT src, local AS dst, line AS call_line FROM sites WHERE local IS NOT NULL UNION ALL SELECT src, e.node_id, line FROM sites JOIN ext e ON e.name = callee WHERE local IS NULL)"""
_SEED = "(SELECT min(name) FROM defs WHERE node_id IN (SELECT s_suppkey FROM supplier))"
_INCLUDES = """files AS (SELECT c_custkey AS node_id, '/n' || c_nationkey || '/c' || c_custkey || '.h' AS file FROM customer),
facts AS (SELECT f.node_id AS includer, 'n' || (o_orderkey % 25) || '/c' || ((o_orderkey * 7) % (n + n // 4)) || '.h' AS place, o_orderpriority = '1-URGENT' AS is_system, o_orderkey AS line FROM orders JOIN files f ON f.node_id = o_custkey, (SELECT count(*) AS n FROM customer)),
resolved AS (SELECT facts.*, g.node_id AS includee FROM facts LEFT JOIN files g ON g.file = '/' || place AND NOT is_system)"""
_USES = f"""{_DEFS},
first_def AS (SELECT file, name, min(node_id) AS node_id FROM defs GROUP BY file, name),
uses AS (SELECT s.node_id AS src, n_name AS type, n_nationkey AS type_line, c_custkey AS line FROM customer JOIN nation ON n_nationkey = c_nationkey, (SELECT count(*) AS n FROM part) JOIN defs d ON d.node_id = c_custkey % n JOIN first_def s ON s.file = d.file AND s.name = d.name)"""
_DECLARES = """defs AS (SELECT p_partkey AS node_id, p_name || ':' || p_type || ':' || p_brand AS name, p_size > 15 AS external FROM part),
by_name AS (SELECT name, count(*) FILTER (external) AS n_ext, min(node_id) FILTER (external) AS ext, count(*) AS n, min(node_id) AS any_id FROM defs GROUP BY name),
links AS (SELECT s_suppkey, CASE WHEN n_ext = 1 THEN ext WHEN n_ext = 0 AND n = 1 THEN any_id END AS def FROM supplier JOIN defs ON node_id = s_suppkey JOIN by_name USING (name))"""


def seed_name(spark: SparkSession, d: str, defs: DataFrame) -> str:
    """The least name that a call site can name: the argument of the queries that ask about one name."""
    named = defs.join(_read(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id")), "node_id", "left_semi")
    return named.agg(F.min("name").alias("name")).first()["name"] or ""


# -- queries ------------------------------------------------------------------
@query(f"WITH {_DEFS} SELECT name, file, line FROM defs WHERE name = {_SEED}")
def find_definition(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    name = seed_name(spark, d, defs)
    return navigate.find_definition(defs, name).withColumn("name", F.lit(name))


@query(f"""WITH long_names AS (SELECT p_name || ':' || p_type || ':' || p_brand AS name, s_suppkey FROM supplier JOIN part ON p_partkey = s_suppkey)
SELECT 'decls.h' AS file, s_suppkey AS line FROM long_names WHERE name = (SELECT min(name) FROM long_names)""")
def find_declarations(spark: SparkSession, d: str) -> DataFrame:
    nodes = declared(spark, d)
    name = nodes.where(F.col("kind") == DECLARATION).agg(F.min("name").alias("name")).first()["name"] or ""
    return navigate.find_declarations(nodes, name)


@query(f"WITH {_CALLS} SELECT * FROM calls")
def calls_resolved(spark: SparkSession, d: str) -> DataFrame:
    return calls(spark, d)


@query(f"WITH {_CALLS} SELECT DISTINCT c.file, c.line FROM calls JOIN defs t ON t.node_id = dst JOIN defs c ON c.node_id = src WHERE t.name = {_SEED}")
def who_calls(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    return navigate.who_calls(defs, calls(spark, d), seed_name(spark, d, defs))


@query(f"WITH {_CALLS} SELECT DISTINCT c.file, call_line AS line FROM calls JOIN defs t ON t.node_id = dst JOIN defs c ON c.node_id = src WHERE t.name = {_SEED}")
def call_sites(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    return navigate.call_sites(defs, calls(spark, d), seed_name(spark, d, defs))


_REACH = f"""WITH RECURSIVE {_CALLS},
edges AS (SELECT DISTINCT src, dst FROM calls WHERE src <> dst),
reach(node, depth) USING KEY (node) AS (
  SELECT node_id, 0 FROM defs WHERE name = {_SEED}
  UNION
  SELECT DISTINCT e.src, r.depth + 1 FROM reach r JOIN edges e ON e.dst = r.node LEFT JOIN recurring.reach s ON s.node = e.src WHERE s.node IS NULL)"""


@query(f"{_REACH} SELECT file, line, min(depth)::INT AS depth FROM reach JOIN defs ON node_id = node WHERE depth > 0 GROUP BY file, line")
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    return navigate.blast_radius(defs, calls(spark, d), seed_name(spark, d, defs))


@query(f"{_REACH} SELECT depth::INT AS depth, count(*) AS nodes FROM reach WHERE depth > 0 GROUP BY depth")
def blast_radius_depth(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    found = navigate.transitive_callers(calls(spark, d), defs.where(F.col("name") == seed_name(spark, d, defs)))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"WITH {_SITES}, many AS (SELECT name, count(*) AS n, min(node_id) AS first_id, max(node_id) AS last_id FROM ext GROUP BY name HAVING count(*) > 1) SELECT callee, file AS caller_file, line AS caller_line, n AS candidates, first_id, last_id FROM sites JOIN many ON name = callee WHERE local IS NULL")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    found = resolve.call_conflicts(definitions(spark, d), call_facts(spark, d))
    return found.select("callee", "caller_file", "caller_line", F.size("candidates").cast("long").alias("candidates"), F.array_min("candidates").alias("first_id"), F.array_max("candidates").alias("last_id"))


@query(f"WITH {_DECLARES} SELECT s_suppkey AS decl, def FROM links WHERE def IS NOT NULL")
def declares(spark: SparkSession, d: str) -> DataFrame:
    return resolve.declaration_links(declared(spark, d)).select((-1 - F.col("decl")).alias("decl"), "def")


@query(f"WITH {_INCLUDES} SELECT includer AS src, includee AS dst, line FROM resolved WHERE includee IS NOT NULL")
def include_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.include_edges(includes(spark, d))


@query(f"WITH {_INCLUDES} SELECT includer, '../' || place AS target, is_system, line FROM resolved WHERE includee IS NULL")
def unresolved_includes(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unresolved(includes(spark, d))


@query(
    f"""WITH {_INCLUDES}, hub AS (SELECT includee AS id FROM resolved WHERE includee IS NOT NULL GROUP BY includee ORDER BY count(*) DESC, includee LIMIT 1)
SELECT DISTINCT 'includes' AS section, g.file AS value, NULL::VARCHAR AS tag FROM resolved JOIN files g ON g.node_id = includee WHERE includer = (SELECT id FROM hub)
UNION SELECT 'unresolved', '../' || place, CASE WHEN is_system THEN 'system' ELSE 'external' END FROM resolved WHERE includee IS NULL AND includer = (SELECT id FROM hub)
UNION SELECT 'included_by', f.file, NULL FROM resolved JOIN files f ON f.node_id = includer WHERE includee = (SELECT id FROM hub)"""
)
def include_graph(spark: SparkSession, d: str) -> DataFrame:
    """Around the file that most directives include."""
    files, found = include_files(spark, d), includes(spark, d)
    edges = resolve.include_edges(found)
    hub = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).join(files.select(F.col("node_id").alias("dst"), "name"), "dst").first()
    return navigate.include_graph(files, edges, resolve.unresolved(found), hub["name"] if hub else "")


@query(f"WITH {_USES} SELECT src, -1 - type_line::BIGINT AS dst, line FROM uses")
def type_uses(spark: SparkSession, d: str) -> DataFrame:
    return resolve.type_use_edges(typed(spark, d), type_use_facts(spark, d))


@query(f"WITH {_USES} SELECT DISTINCT file, defs.line FROM uses JOIN defs ON node_id = src WHERE type = (SELECT min(n_name) FROM nation)")
def who_uses_type(spark: SparkSession, d: str) -> DataFrame:
    nodes = typed(spark, d)
    name = _read(spark, d, "nation").agg(F.min("n_name").alias("n")).first()["n"]
    return navigate.who_uses_type(nodes, resolve.type_use_edges(nodes, type_use_facts(spark, d)), name)


_LONG = _DECLARES.replace("defs AS", "long_defs AS").replace("FROM defs", "FROM long_defs").replace("JOIN defs", "JOIN long_defs")
_FOUR = f"""WITH {_CALLS}, {_LONG},
includes AS (SELECT * FROM (WITH {_INCLUDES} SELECT * FROM resolved) WHERE includee IS NOT NULL),
uses AS (SELECT c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey, (SELECT count(*) AS n FROM part) JOIN defs d ON d.node_id = c_custkey % n),
total AS (SELECT ((SELECT count(*) FROM calls) + (SELECT count(def) FROM links) + (SELECT count(*) FROM includes) + (SELECT count(*) FROM uses))::BIGINT AS edges)"""


def _relations(spark: SparkSession, d: str) -> list[DataFrame]:
    """Declares, calls, includes, type uses."""
    uses = resolve.type_use_edges(typed(spark, d), type_use_facts(spark, d))
    return [resolve.declaration_links(declared(spark, d)), calls(spark, d), resolve.include_edges(includes(spark, d)), uses]


@query(f"{_FOUR} SELECT edges FROM total")
def edge_count(spark: SparkSession, d: str) -> DataFrame:
    return measure.edge_count(*_relations(spark, d)).select(F.col("edges").cast("long").alias("edges"))


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    return declared(spark, d).unionByName(include_files(spark, d)).unionByName(typed(spark, d).where("kind = 'Struct'"))


@query("SELECT 'Function' AS kind, count(*) AS n FROM part UNION ALL SELECT 'FunctionDecl', count(*) FROM supplier JOIN part ON p_partkey = s_suppkey UNION ALL SELECT 'File', count(*) FROM customer UNION ALL SELECT 'Struct', count(*) FROM nation")
def nodes_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return measure.nodes_by_kind(_all_nodes(spark, d))


@query(f"""{_FOUR} SELECT (SELECT count(*) FROM customer) AS files, (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier JOIN part ON p_partkey = s_suppkey)
+ (SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) AS nodes, edges, (SELECT count(*) FROM documents WHERE lang IS NULL) AS skipped FROM total""")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    skipped = _read(spark, d, "documents").where("lang is null").select("doc_id")
    found = measure.index_summary(_all_nodes(spark, d), _relations(spark, d), skipped)
    return found.select("files", "nodes", F.col("edges").cast("long").alias("edges"), "skipped")


@query("SELECT doc_id, i AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t, LATERAL (SELECT unnest(range(1, len(parts) + 1))::INT AS i) WHERE regexp_matches(parts[i], '(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')")
def grep_search(spark: SparkSession, d: str) -> DataFrame:
    return search.word_hits(_read(spark, d, "documents"), "the")


_SCORED = """marks AS (SELECT doc_id, lang AS q, coalesce(quality, 0) = 1 AS e, regexp_matches(text, '(^|[^A-Za-z0-9_])(the|der|le|el)($|[^A-Za-z0-9_])') AS r FROM documents LEFT JOIN labels USING (doc_id)),
scored AS (SELECT q, count(*) FILTER (e) AS relevant, count(*) FILTER (r) AS retrieved, count(*) FILTER (e AND r) AS true_positives FROM marks GROUP BY q),
rated AS (SELECT *, CASE WHEN retrieved = 0 THEN 1.0::DOUBLE ELSE true_positives / retrieved END AS p, CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE true_positives / relevant END AS rc FROM scored)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Per language: documents of good quality as truth, documents with an article as answer."""
    docs = _read(spark, d, "documents").select("doc_id", F.col("lang").alias("q"), "text")
    place = [F.lit("doc").alias("file"), F.col("doc_id").alias("line")]
    good = docs.join(_read(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("q", *place)
    found = docs.where(F.col("text").rlike(r"(?<![A-Za-z0-9_])(the|der|le|el)(?![A-Za-z0-9_])")).select("q", *place)
    return measure.scores(good, found, docs.select("q"), ["q"])


@query(f"WITH {_SCORED} SELECT q, relevant, retrieved, true_positives, round(p, 9) AS precision, round(rc, 9) AS recall FROM rated")
def eval_score(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("q", "relevant", "retrieved", "true_positives", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(f"WITH {_SCORED} SELECT 'words' AS tool, round(avg(p), 9) AS precision, round(avg(rc), 9) AS recall, count(*) AS queries FROM rated")
def eval_macro(spark: SparkSession, d: str) -> DataFrame:
    m = measure.macro(_scored(spark, d).withColumn("tool", F.lit("words")))
    return m.select("tool", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "queries")


@query("SELECT count(*) FILTER (doc_id % 2 = 0 AND doc_id % 6 <> 0) AS files_reused, count(*) FILTER (NOT (doc_id % 2 = 0 AND doc_id % 6 <> 0)) AS files_parsed FROM documents")
def reindex_split(spark: SparkSession, d: str) -> DataFrame:
    """Even documents as prior artifacts, every third of them changed since."""
    from .index import split_unchanged

    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash"))
    old = F.when(F.col("doc_id") % 6 == 0, F.md5(F.concat("hash", F.lit("old")).cast("binary"))).otherwise(F.col("hash"))
    prior = docs.where("doc_id % 2 = 0").withColumn("hash", old).withColumn("status", F.lit(OK))
    reused, changed = split_unchanged(docs, prior)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(reused, "files_reused").crossJoin(count(changed, "files_parsed"))  # one row each


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, max(value) AS max, min(value) AS min, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return measure.latency_summary(_read(spark, d, "events"), "value", ["event_type"])


@query("WITH names AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_name || ':' || p_type AS name FROM part)) SELECT name FROM names WHERE n <= 50 OR r IN (SELECT (i * (n - 1)) // 49 FROM range(50) t(i))")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return measure.even_sample(definitions(spark, d), 50)


@query("SELECT p_partkey AS node_id, p_brand AS file FROM part WHERE p_name || ':' || p_type = (SELECT max(p_name || ':' || p_type) FROM part)")
def nodes_named(spark: SparkSession, d: str) -> DataFrame:
    defs = definitions(spark, d)
    name = defs.agg(F.max("name").alias("n")).first()["n"]
    return navigate.nodes_named(defs, name).select("node_id", "file")


@query(f"WITH {_DEFS} SELECT file, name, min(node_id) AS node_id FROM defs GROUP BY file, name")
def first_definitions(spark: SparkSession, d: str) -> DataFrame:
    return resolve.first_definitions(definitions(spark, d))


@query(f"WITH {_SITES} SELECT src, file, callee, line FROM sites")
def attributed_calls(spark: SparkSession, d: str) -> DataFrame:
    return resolve.attributed(definitions(spark, d), call_facts(spark, d), "caller").select("src", "file", "callee", "line")


@query(f"WITH {_CALLS} SELECT src AS node_id, count(*) AS n FROM calls JOIN defs ON node_id = dst WHERE internal GROUP BY src")
def callers_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Callers of the internal functions, with how many calls they make."""
    defs = definitions(spark, d)
    return navigate.neighbours(calls(spark, d), defs.where(F.col("linkage") == INTERNAL)).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_INCLUDES}, hub AS (SELECT includee AS id FROM resolved WHERE includee IS NOT NULL GROUP BY includee HAVING count(*) > 1), e AS (SELECT includer AS src, includee AS dst FROM resolved WHERE includee IS NOT NULL) SELECT 'includes' AS direction, dst AS node_id FROM e WHERE src IN (SELECT id FROM hub) UNION ALL SELECT 'included_by', src FROM e WHERE dst IN (SELECT id FROM hub)")
def includes_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """One hop from the files that two directives or more include, both ways."""
    edges = resolve.include_edges(includes(spark, d))
    hubs = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("dst").alias("node_id"))
    near = lambda reverse, name: navigate.neighbours(edges, hubs, reverse).select(F.lit(name).alias("direction"), "node_id")
    return near(False, "includes").unionByName(near(True, "included_by"))


@query(f"WITH {_DECLARES} SELECT def AS node_id, p_brand AS file, count(*) AS declarations FROM links JOIN part ON p_partkey = def WHERE def IS NOT NULL GROUP BY def, p_brand")
def definition_of(spark: SparkSession, d: str) -> DataFrame:
    """The definitions that all declarations lead to."""
    nodes = declared(spark, d)
    links = navigate.definition_of(resolve.declaration_links(nodes), nodes.where(F.col("kind") == DECLARATION))
    at = nodes.select(F.col("node_id").alias("def"), "file")
    return links.join(at, "def").groupBy(F.col("def").alias("node_id"), "file").agg(F.count(F.lit(1)).alias("declarations"))


def _grep_lines(spark: SparkSession, d: str) -> DataFrame:
    """(file, line, text) of every line of the documents."""
    docs = _read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return docs.select("file", (F.col("pos") + 1).alias("line"), "text")


_WORDS = ("the", "der", "License", "C++", "e")


@query("SELECT w AS symbol, doc_id::VARCHAR AS file, i AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t, LATERAL (SELECT unnest(range(1, len(parts) + 1))::INT AS i), (SELECT unnest(['the', 'der', 'License', 'C++', 'e']) AS w) WHERE contains(parts[i], w) AND regexp_matches(parts[i], '(^|[^A-Za-z0-9_])' || regexp_escape(w) || '($|[^A-Za-z0-9_])')")
def grep_many(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold any of a few symbols, one of them no plain word, in one pass."""
    return search.grep_many(_grep_lines(spark, d), list(_WORDS))


@query("SELECT doc_id::VARCHAR AS file, i AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) t, LATERAL (SELECT unnest(range(1, len(parts) + 1))::INT AS i) WHERE regexp_matches(parts[i], '(^|[^A-Za-z0-9_])License($|[^A-Za-z0-9_])')")
def grep_lines(spark: SparkSession, d: str) -> DataFrame:
    return search.grep(_grep_lines(spark, d), "License")
