"""Incremental indexing of a stream of file snapshots (path, rel, content), as foreachBatch over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..plans.index import graph_of
from ..sources import store, trees


def merged(spark: SparkSession, batch: DataFrame, index_path: str) -> None:
    """Parse a batch's files, replace their artifacts in the stored index, resolve anew, and store. Null content deletes a file.

    Of several snapshots of a path in one batch the last by column `seq` counts (one snapshot if there is no such column).
    """
    if "seq" in batch.columns:
        batch = batch.withColumn("_r", F.row_number().over(W.partitionBy("path").orderBy(F.desc("seq")))).where("_r = 1").drop("_r", "seq")
    batch = cut(batch.select("path", "rel", "content"))
    fresh = trees.parse_contents(batch.where("content is not null"))
    try:
        prior = store.load(spark, index_path)[1]
    except store.NoIndexError:
        prior = None
    kept = fresh if prior is None else prior.join(batch.select("path"), "path", "left_anti").select(*fresh.columns).unionByName(fresh)
    graph_of(cut(kept)).save(index_path)


def watch(snapshots: DataFrame, index_path: str, checkpoint: str):
    """A streaming query that keeps the index at index_path up to date with a stream of snapshots."""
    spark = snapshots.sparkSession
    return snapshots.writeStream.foreachBatch(lambda df, _: merged(spark, df, index_path)).option("checkpointLocation", checkpoint).start()
