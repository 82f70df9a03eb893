"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import cut, shared_dir

__all__ = ["SPACE", "components", "cut", "dense_rank_rows", "numbered_rows", "shared_dir", "table", "text_of", "words_of"]

#: ASCII white space: space and \x09 to \x0D. A word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def dense_rank_rows(rows: DataFrame, key: list[str], order: list[Column], buckets: int | Column) -> DataFrame:
    """Number rows 0.. within each key, without one task for a whole key.

    Rows fall into buckets by a hash of their order columns; each bucket of a key is ranked by
    itself, and bucket counts (one row per key and bucket) give the offsets. buckets: how many
    there are for a row's key, as a number or as a column that depends on the key; the root of the
    key's rows keeps both a bucket and the table of offsets small. Adds column rn.
    """
    many = F.lit(buckets) if isinstance(buckets, int) else buckets
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), many).cast("int"))
    counts = rows.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_bucket").alias("_b"), "_before")
    local = rows.withColumn("_rank", F.row_number().over(W.partitionBy(*key, "_bucket").orderBy(*order)).cast("long") - 1)
    on = [local["_bucket"] == offsets["_b"], *[local[k].eqNullSafe(offsets[f"_k{i}"]) for i, k in enumerate(key)]]
    out = local.join(offsets, on, "inner").withColumn("rn", F.col("_rank") + F.col("_before"))
    return out.drop("_bucket", "_rank", "_b", "_before", *[f"_k{i}" for i in range(len(key))])


def numbered_rows(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, written to the shared folder, with dense numbers 0.. in the plain order of the given columns, nulls first.

    Rows are dealt into ranges and sorted there; one count per range meets in one place. Where very many
    rows are equal in all order columns, a hash of their place in the input deals them to several ranges.
    """
    placed = rows.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    dealt = placed.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = cut(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    out = kept.withColumn("_part", part).join(starts, "_part").withColumn(name, within + F.col("_start"))
    return out.select(*rows.columns, name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): one row (node, root) per node, root its smallest reachable node.

    Alternates large-star and small-star steps: O(log n) rounds, all of them joins and minima
    that Spark combines before it shuffles. Every round is written to the shared folder.
    An edge from a node to itself keeps the node. Null ends are dropped.
    """
    ends = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    state = cut(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b >= a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        down = large.where("b <= a")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b")))
        state = cut(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        mark = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return state.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = mark
    raise RuntimeError("components did not settle")
