"""Benchmark: index time, query latency, scaling over threads, cold against warm."""

from __future__ import annotations

import json
import resource
import time
import uuid
from statistics import median

from pyspark.sql import SparkSession

from ..functions.scalars import human_bytes
from ..functions.storage import cut, shared_dir
from ..model import FUNCTION
from ..operators import measure
from ..sources import store, trees
from .index import Graph, build_index, graph_of

QUERIES = ("find_definition", "who_calls", "blast_radius")


def _timed(f) -> float:
    start = time.perf_counter()
    f()
    return time.perf_counter() - start


def thread_counts(most: int) -> list[int]:
    """1, 2, 4 ... and most."""
    out = [1]
    while out[-1] * 2 < most:
        out.append(out[-1] * 2)
    return out if most <= 1 else [*out, most]


def interpolated(values: list[float], p: float) -> float:
    """Linear interpolation at rank p * (n - 1); 0 for none."""
    if not values:
        return 0.0
    values = sorted(values)
    at = p * (len(values) - 1)
    low = int(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


def peak_kib(spark: SparkSession) -> int:
    """Peak resident memory of the engine on this machine: the driver's JVM, and this process with its Python workers."""
    try:
        jvm = int(spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid())
        with open(f"/proc/{jvm}/status", encoding="ascii") as f:
            own = next(int(line.split()[1]) for line in f if line.startswith("VmHWM"))
    except (OSError, StopIteration, ValueError):
        own = 0
    return own + resource.getrusage(resource.RUSAGE_SELF).ru_maxrss + resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss


def _scaled(spark: SparkSession, root: str, n: int, force) -> float:
    """Seconds of a whole index in n partitions, n tasks at once at most; the session's setting is put back."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        return _timed(lambda: force(graph_of(cut(trees.parse(trees.paths_table(spark, root).coalesce(n))))))
    finally:
        spark.conf.set(key, before)


def benchmark(spark: SparkSession, root: str, runs: int = 5, sample: int = 50, repeats: int = 5) -> dict:
    """A report: input size, median wall time, rates, latency of three queries over an even sample of function names, cold against warm, scaling of the whole index."""
    size = measure_size(spark, root)
    force = lambda g: [df.count() for df in g.relations.values()]
    walls = [_timed(lambda: force(build_index(spark, root))) for _ in range(max(1, runs))]
    wall = median(walls)
    path = f"{shared_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    build_index(spark, root).save(path)
    warm_s = _timed(lambda: store.load(spark, path))
    graph = Graph(*store.load(spark, path), stored=True)
    names = [r.name for r in measure.even_sample(graph.nodes.where(f"kind = '{FUNCTION}'"), sample).collect()]
    latency = {}
    for q in QUERIES:
        best = [min(_timed(lambda n=n: getattr(graph, q)(n).collect()) for _ in range(max(1, repeats))) for n in names]
        latency[q] = {"n": len(best), **{k: interpolated(best, p) for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))}, "max": max(best, default=0.0)}
    on_disk = store.stored_bytes(spark, path)
    store.remove(spark, path)
    rate = lambda n: n / wall if wall else 0.0
    scaling = []
    for n in thread_counts(spark.sparkContext.defaultParallelism):
        t = _scaled(spark, root, n, force)
        scaling.append({"tasks": n, "seconds": t, "speed_up": scaling[0]["seconds"] / t if scaling and t else 1.0})
    return {
        "root": root,
        "input": size,
        "index": {"seconds": wall, "runs": walls, "files_per_s": rate(size["files"]), "lines_per_s": rate(size["lines"]), "peak_rss_kib": peak_kib(spark)},
        "latency": latency,
        "scaling": scaling,
        "persistence": {"cold_s": wall, "warm_s": warm_s, "speed_up": wall / warm_s if warm_s else 0.0, "bytes": on_disk},
    }


def measure_size(spark: SparkSession, root: str) -> dict:
    """files, bytes and lines, read but not parsed."""
    return trees.input_size(trees.sizes(trees.paths_table(spark, root))).first().asDict()


def as_json(report: dict) -> str:
    return json.dumps(report, indent=2)


def summary(report: dict) -> str:
    i, x = report["input"], report["index"]
    out = [f"{i['files']} files, {i['lines']} lines, {human_bytes(i['bytes'])}", f"index {x['seconds']:.2f} s, {x['files_per_s']:.0f} files/s, {x['lines_per_s']:.0f} lines/s, peak {human_bytes(x['peak_rss_kib'] * 1024)}"]
    out += [f"{q:<16} p50 {v['p50'] * 1e3:.1f} ms  p95 {v['p95'] * 1e3:.1f}  p99 {v['p99'] * 1e3:.1f}  max {v['max'] * 1e3:.1f}  (n={v['n']})" for q, v in report["latency"].items()]
    out += [f"{s['tasks']} tasks {s['seconds']:.2f} s, {s['speed_up']:.2f} x" for s in report["scaling"]]
    p = report["persistence"]
    return "\n".join([*out, f"cold {p['cold_s']:.2f} s, warm {p['warm_s']:.2f} s, {p['speed_up']:.1f} x, {human_bytes(p['bytes'])} on disk"])
