"""Ground truth: one query per line, `<query> <symbol> [file:line ...]`; blank lines and # comments are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = ("find-definition", "who-calls")


def parse_line(text: str, where: str) -> tuple[str, str, list[tuple[str, int]]] | None:
    words = text.split()
    if not words or words[0].startswith("#"):
        return None
    if words[0] not in QUERIES:
        raise ValueError(f"{where}: unknown query {words[0]!r}")
    if len(words) < 2:
        raise ValueError(f"{where}: a symbol is missing")
    places = []
    for word in words[2:]:
        file, colon, line = word.rpartition(":")
        if not colon or not file or not line.isascii() or not line.isdigit():
            raise ValueError(f"{where}: {word!r} is not file:line")
        places.append((file, int(line)))
    return words[0], words[1], places


def load_truth(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries: query, symbol), (expected: query, symbol, file, line). A wrong line is an error that names it."""
    queries, expected = [], []
    with open(path, encoding="utf-8") as f:
        for n, text in enumerate(f, 1):
            row = parse_line(text, f"{path}:{n}")
            if row:
                queries.append(row[:2])
                expected += [(*row[:2], file, line) for file, line in row[2]]
    return spark.createDataFrame(queries, "query string, symbol string"), spark.createDataFrame(expected, "query string, symbol string, file string, line int")


def truth_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As load_truth, of lines (column value) in a DataFrame: read in Arrow batches, whatever their number."""
    import pyarrow as pa

    kind = pa.list_(pa.struct([("file", pa.string()), ("line", pa.int32())]))

    def run(batches):
        for b in batches:
            rows = [r for r in (parse_line(v or "", "ground truth") for v in b.column("value").to_pylist()) if r]
            places = [[{"file": f, "line": n} for f, n in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(places, kind)], ["query", "symbol", "places"])

    found = lines.select("value").mapInArrow(run, "query string, symbol string, places array<struct<file:string,line:int>>")
    each = found.select("query", "symbol", F.explode("places").alias("p")).select("query", "symbol", "p.file", "p.line")
    return found.select("query", "symbol").distinct(), each
