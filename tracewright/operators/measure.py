"""Counts, scores, percentiles and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import FILE


def edge_count(*relations: DataFrame) -> DataFrame:
    """One row: edges, repeats counted, over all relations given."""
    counts = [r.agg(F.count(F.lit(1)).alias("n")) for r in relations]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionAll(c)
    return out.agg(F.sum("n").alias("edges"))


def index_summary(nodes: DataFrame, relations: list[DataFrame], skipped: DataFrame) -> DataFrame:
    """One row: files, nodes, edges, skipped."""
    n = nodes.agg(F.count_if(F.col("kind") == FILE).alias("files"), F.count(F.lit(1)).alias("nodes"))
    return n.crossJoin(edge_count(*relations)).crossJoin(skipped.agg(F.count(F.lit(1)).alias("skipped")))  # one row each


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def scores(truth: DataFrame, answers: DataFrame, queries: DataFrame, on: list[str]) -> DataFrame:
    """Per query (columns `on`): relevant, retrieved, true_positives, precision, recall, as sets of (file, line).

    An empty answer has precision 1, an empty truth recall 1. queries holds every query, so those
    with neither stay.
    """
    item = [*on, "file", "line"]
    marks = truth.select(*item).distinct().withColumn("_e", F.lit(1)).unionByName(answers.select(*item).distinct().withColumn("_e", F.lit(2)))
    per_item = marks.groupBy(*item).agg(F.sum("_e").alias("_m"))
    n = lambda *values: F.coalesce(F.count_if(F.col("_m").isin(*values)), F.lit(0))
    per_query = per_item.groupBy(*on).agg(n(1, 3).alias("relevant"), n(2, 3).alias("retrieved"), n(3).alias("true_positives"))
    out = queries.select(*on).distinct().join(per_query, on, "left").na.fill(0, ["relevant", "retrieved", "true_positives"])
    ratio = lambda part, whole: F.when(F.col(whole) == 0, 1.0).otherwise(F.col(part) / F.col(whole))
    return out.withColumns({"precision": ratio("true_positives", "retrieved"), "recall": ratio("true_positives", "relevant")})


def macro(scored: DataFrame, by: str = "tool") -> DataFrame:
    """Mean precision and recall over queries, per tool."""
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0)).alias(c)
    return scored.groupBy(by).agg(mean("precision"), mean("recall"), F.count(F.lit(1)).alias("queries"))


def percentile(col: str, p: float) -> Column:
    """Linear interpolation at rank p * (n - 1); no rows give 0."""
    return F.coalesce(F.percentile(F.col(col), F.lit(p)), F.lit(0.0))


def latency_summary(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """p50, p95, p99, max and min of a column."""
    agg = [percentile(col, p).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    return df.groupBy(*by).agg(*agg, F.max(col).alias("max"), F.min(col).alias("min"), F.count(F.lit(1)).alias("n"))


def even_sample(names: DataFrame, k: int, col: str = "name") -> DataFrame:
    """k of the distinct names at even steps of their sorted order: position i * (n - 1) div (k - 1). k = 0 or n <= k gives all, k = 1 the first.

    Names are ranked in ranges, whose counts alone meet in one place.
    """
    from ..functions.storage import cut

    ranged = cut(names.select(F.col(col).alias("name")).where(F.col("name").isNotNull()).distinct().repartitionByRange("name").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("part").orderBy("name")) - 1
    ranked = ranged.withColumn("_r", rank).join(starts, "part").select("name", (F.col("start") + F.col("_r")).alias("rank"))
    n = ranged.count()
    if not k or n <= k:
        return ranked.select("name")
    wanted = sorted({i * (n - 1) // (k - 1) for i in range(k)}) if k > 1 else [0]
    return ranked.join(names.sparkSession.createDataFrame([(w,) for w in wanted], "rank long"), "rank", "left_semi").select("name")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole)
