"""Cutting lineage with tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session gets a temporary folder and a cluster is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir() or at
    return at


def cut(df: DataFrame, by: str | None = None, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that later steps and lost executors don't compute it again.

    by: a column whose values the table is bucketed by, so that a join or group on it moves no row of the table again.
    """
    spark = df.sparkSession
    name = f"cut_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name.replace('_', '-')}"
    _made.append(path)
    if by is None:
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").options(path=path, **options).bucketBy(buckets, by).saveAsTable(name)
    return spark.table(name)


def release(spark: SparkSession) -> int:
    """Delete the tables that this process has cut so far, once no DataFrame made of them is needed. Gives how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
