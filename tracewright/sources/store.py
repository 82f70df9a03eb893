"""The stored index: versions side by side, each one Parquet table per relation, and a manifest that names the one in use.

A version is written whole before the manifest is switched, so that a reader finds the old index or the
new one. A switch that fails raises and leaves the old version's tables in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ARTIFACTS, RELATIONS

FORMAT, VERSION, DEFAULT_NAME = "tracewright-index", 1, ".tracewright.index"


class IndexFormatError(ValueError):
    """The folder is no index, or not one that this version reads."""


class NoIndexError(IndexFormatError):
    """There is no index at the path."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(relations: dict[str, DataFrame], path: str, artifacts: DataFrame | None = None) -> None:
    """Write all relations (and artifacts, for later incremental runs). A reader sees the old index or the new one.

    Nodes lie sorted by name and edges by target, so that lookups skip row groups.
    """
    spark = relations["nodes"].sparkSession
    jvm, target, fs = _fs(spark, path)
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}")
    version = f"v-{uuid.uuid4().hex}"
    aside = f"{path.rstrip('/')}/{version}"
    order = {"nodes": "name", "calls": "dst", "uses_type": "dst", "includes": "dst"}
    counts = {}
    for name, schema in RELATIONS.items():
        df = relations[name]
        df = df.sortWithinPartitions(order[name]) if name in order else df
        df.write.parquet(f"{aside}/{name}")
        counts[name] = spark.read.schema(schema).parquet(f"{aside}/{name}").count()
    if artifacts is not None:
        artifacts.write.parquet(f"{aside}/artifacts")
    before = _version(spark, path)
    _write(jvm, fs, f"{path.rstrip('/')}/{version}.json", json.dumps({"format": FORMAT, "version": VERSION, "counts": counts, "artifacts": artifacts is not None, "at": version}))
    if target.toUri().getScheme():
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(at(f"{version}.json"), at("manifest.json"), options)
    else:  # a plain path of the session's own file system: two steps, held to their answers
        if fs.exists(at("manifest.json")) and not fs.delete(at("manifest.json"), False):
            raise OSError(f"{path}: the manifest can't be replaced")
        if not fs.rename(at(f"{version}.json"), at("manifest.json")):
            raise OSError(f"{path}: the manifest can't be written")
    if before:
        fs.delete(at(before), True)


def _write(jvm, fs, path: str, text: str) -> None:
    out = fs.create(jvm.org.apache.hadoop.fs.Path(path))
    out.write(bytearray(text.encode()))
    out.close()


def _version(spark: SparkSession, path: str) -> str | None:
    """The name of the version in use, if there is one that can be told."""
    try:
        return manifest(spark, path)["at"]
    except IndexFormatError:
        return None


def manifest(spark: SparkSession, path: str) -> dict:
    jvm, _, fs = _fs(spark, path)
    at = f"{path.rstrip('/')}/manifest.json"
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(at)):
        raise NoIndexError(f"{path}: no index")
    text = "\n".join(r.value for r in spark.read.text(at).collect())
    try:
        found = json.loads(text)
    except ValueError as e:
        raise IndexFormatError(f"{path}: the manifest can't be read") from e
    if not isinstance(found, dict) or found.get("format") != FORMAT:
        raise IndexFormatError(f"{path}: a foreign format")
    if found.get("version") != VERSION:
        raise IndexFormatError(f"{path}: version {found.get('version')} is not {VERSION}")
    if set(found.get("counts", {})) != set(RELATIONS) or not isinstance(found.get("at"), str):
        raise IndexFormatError(f"{path}: relations are missing")
    return found


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame | None]:
    """All relations, with explicit schemas, and the artifacts if they were kept. Row counts come from Parquet footers."""
    told = manifest(spark, path)
    out = {}
    for name, schema in RELATIONS.items():
        try:
            df = spark.read.schema(schema).parquet(f"{path.rstrip('/')}/{told['at']}/{name}")
            n = df.select(F.lit(1)).count()
        except Exception as e:  # a missing or damaged table
            raise IndexFormatError(f"{path}: {name} can't be read") from e
        if n != told["counts"][name]:
            raise IndexFormatError(f"{path}: {name} has {n} rows, not {told['counts'][name]}")
        out[name] = df
    artifacts = spark.read.schema(ARTIFACTS).parquet(f"{path.rstrip('/')}/{told['at']}/artifacts") if told.get("artifacts") else None
    return out, artifacts


def stored_bytes(spark: SparkSession, path: str) -> int:
    _, at, fs = _fs(spark, path)
    return int(fs.getContentSummary(at).getLength())


def remove(spark: SparkSession, path: str) -> None:
    _, at, fs = _fs(spark, path)
    fs.delete(at, True)
