"""C source trees: crawl, read, hash and parse files into artifacts, one row per file, and further ones where it has very many facts."""

from __future__ import annotations

import os
from collections.abc import Collection, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import content_hash, include_target
from ..model import ARTIFACTS, OK, SYNTAX_ERROR, UNREADABLE
from .c_facts import extract

SUFFIXES = (".c", ".h")


def _list_of(**fields: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct(list(fields.items())))


_S, _I, _L, _B = pa.string(), pa.int32(), pa.int64(), pa.bool_()
#: model.ARTIFACTS for Arrow.
_SCHEMA = pa.schema(
    [("path", _S), ("rel", _S), ("status", _S), ("hash", _L), ("bytes", _L), ("lines", _L)]
    + [
        ("definitions", _list_of(name=_S, line=_I, is_static=_B)),
        ("declarations", _list_of(name=_S, line=_I)),
        ("calls", _list_of(caller=_S, callee=_S, line=_I)),
        ("includes", _list_of(target=_S, is_system=_B, line=_I, resolved=_S)),
        ("types", _list_of(name=_S, line=_I, category=_S)),
        ("type_uses", _list_of(function=_S, type=_S, line=_I)),
    ]
)


def is_c_source(path: str) -> bool:
    return path.endswith(SUFFIXES)


def crawl(root: str) -> list[str]:
    """Regular files ending in .c or .h, hidden ones too; folders behind links and unreadable folders are passed over. Sorted."""
    out = []
    for folder, _, names in os.walk(root, followlinks=False):
        out += [p for n in names if is_c_source(n) and os.path.isfile(p := os.path.join(folder, n))]
    return sorted(out)


def paths_table(spark: SparkSession, root: str, files_per_task: int = 64) -> DataFrame:
    """(path, rel) of every C source below root, dealt so that slow files balance."""
    rows = [(p, os.path.relpath(p, root).replace(os.sep, "/")) for p in crawl(root)]
    tasks = max(1, -(-len(rows) // files_per_task))
    return spark.createDataFrame(rows, "path string, rel string").repartition(tasks)


def contents_table(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel, content) of every C source below root, listed and read by Spark's own source, from any store that it reads.

    Listing and reading are distributed and tasks are cut by bytes; files and folders whose name begins with _ or . are passed over, as Spark does.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{c,h}").load(root)
    base = root.rstrip("/") + "/"
    rel = F.substring_index("path", base.split("://", 1)[-1], -1)
    return files.select("path", rel.alias("rel"), "content")


#: Relations of facts with their fields.
RELATIONS = tuple(_SCHEMA.names[6:])
_FACTS = {n: [f.name for f in _SCHEMA.field(n).type.value_type] for n in RELATIONS}
#: Bytes of files whose rows make up a batch, and facts that wait as Python objects, at most (but for one file or piece).
BATCH_BYTES, WAITING = 4_000_000, 5_000


class _Artifacts:
    """Rows of files. Facts lie in Arrow columns but for the last few, as a file may have millions. keep: the relations whose facts are kept."""

    def __init__(self, keep: Collection[str] = RELATIONS) -> None:
        self.keep = keep
        self.flat = {n: [] for n in _SCHEMA.names[:6]}
        self.ends = {n: [0] for n in _FACTS}
        self.waiting = {n: [] for n in _FACTS}
        self.chunks = {n: [] for n in _FACTS}
        self.bytes = 0

    @staticmethod
    def _arrow(name: str, rows: list[tuple]) -> pa.Array:
        kind = _SCHEMA.field(name).type.value_type
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)], fields=list(kind))

    def _settle(self) -> None:
        """Waiting facts to Arrow."""
        for name, rows in self.waiting.items():
            if rows:
                self.chunks[name].append(self._arrow(name, rows))
                rows.clear()

    def add(self, path: str, rel: str, data: bytes | None) -> None:
        """One file's row. data None: it could not be read."""
        status, sizes = UNREADABLE, (0, 0, 0)
        counts, early = dict.fromkeys(_FACTS, 0), {n: [] for n in _FACTS}

        def take(facts) -> None:
            for n in _FACTS:
                if n not in self.keep:
                    getattr(facts, n).clear()
            if sum(len(getattr(facts, n)) for n in _FACTS) < WAITING:
                return
            for n in _FACTS:
                if rows := getattr(facts, n):
                    early[n].append(self._arrow(n, rows if n != "includes" else _targets(path, rows)))
                    rows.clear()

        if data is not None:
            status, sizes = SYNTAX_ERROR, (content_hash(data), len(data), data.count(b"\n"))
            if (facts := extract(data.decode("utf-8", "replace"), take)) is not None:
                status = OK
                if any(early.values()):
                    self._settle()
                    for n, arrays in early.items():
                        self.chunks[n] += arrays
                        counts[n] = sum(map(len, arrays))
                for n in _FACTS:
                    rows = getattr(facts, n) if n != "includes" else _targets(path, facts.includes)
                    self.waiting[n] += rows
                    counts[n] += len(rows)
                if sum(map(len, self.waiting.values())) >= WAITING:
                    self._settle()
            self.bytes += len(data)
        for values, v in zip(self.flat.values(), (path, rel, status, *sizes)):
            values.append(v)
        for n, ends in self.ends.items():
            ends.append(ends[-1] + counts[n])

    def batch(self) -> pa.RecordBatch:
        self._settle()
        out = [pa.array(v, _SCHEMA.field(n).type) for n, v in self.flat.items()]
        for n, ends in self.ends.items():
            chunks, kind = self.chunks.pop(n), _SCHEMA.field(n).type
            values = pa.concat_arrays(chunks) if chunks else pa.array([], kind.value_type)
            out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind))
        return pa.RecordBatch.from_arrays(out, schema=_SCHEMA)


#: Facts that a row of artifacts holds at most of each of these relations; a file with more has further rows.
PART, PARTED = 128, ("calls", "includes", "type_uses")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of files with those cut that hold more than PART facts of a relation, as readers take thousands of rows at once.

    The first row of a file has all but the further facts. The others have those, its path, rel, status and hash, and null bytes and lines.
    """
    most = np.max([np.diff(batch.column(n).offsets.to_numpy()) for n in PARTED], axis=0)
    start = 0
    for k in np.flatnonzero(most > PART).tolist():
        if k > start:
            yield batch.slice(start, k - start)
        start, row, out = k + 1, batch.slice(k, 1), []
        n = -(-int(most[k]) // PART)
        for name, kind in zip(_SCHEMA.names, _SCHEMA.types):
            column = row.column(name)
            if name in PARTED or name in _FACTS:
                values = column.flatten()
                ends = np.minimum(np.arange(n + 1) * PART, len(values)) if name in PARTED else np.r_[0, np.full(n, len(values))]
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=kind))
            else:
                first = column[0].as_py()
                out.append(pa.array([first, *[None if name in ("bytes", "lines") else first] * (n - 1)], kind))
        whole = pa.RecordBatch.from_arrays(out, schema=_SCHEMA)
        yield from (whole.slice(at, 1_000) for at in range(0, n, 1_000))
    if start < batch.num_rows:
        yield batch.slice(start)


def files_of(artifacts: DataFrame) -> DataFrame:
    """The first row of each file."""
    return artifacts.where(F.col("bytes").isNotNull())


def _targets(path: str, includes: list[tuple[str, bool, int]]) -> list[tuple]:
    return [(t, s, i, None if s else include_target(path, t)) for t, s, i in includes]


def _batches(files: Iterator[tuple[str, str, bytes | None]], keep: Collection[str] = RELATIONS) -> Iterator[pa.RecordBatch]:
    rows = _Artifacts(keep)
    for path, rel, data in files:
        rows.add(path, rel, data)
        if rows.bytes >= BATCH_BYTES or len(rows.flat["path"]) >= 10_000:
            yield from _parts(rows.batch())
            rows = _Artifacts(keep)
            pa.default_memory_pool().release_unused()
    if rows.flat["path"]:
        yield from _parts(rows.batch())


def _read(path: str) -> bytes | None:
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batches((p, r, _read(p)) for b in batches for p, r in zip(b.column("path").to_pylist(), b.column("rel").to_pylist()))


def parse(paths: DataFrame) -> DataFrame:
    """Artifacts of the files in paths (path, rel)."""
    return paths.select("path", "rel").mapInArrow(_parse, ARTIFACTS)


def _parse_binary(batches: Iterator[pa.RecordBatch], keep: Collection[str]) -> Iterator[pa.RecordBatch]:
    yield from _batches((tuple(b.column(n)[i].as_py() for n in ("path", "rel", "content")) for b in batches for i in range(b.num_rows)), keep)


def parse_contents(files: DataFrame, keep: Collection[str] = RELATIONS) -> DataFrame:
    """Artifacts of files given with their contents (path, rel, content): for stores that only Spark reads. keep: as in parse_pieces."""
    return files.select("path", "rel", F.col("content").cast("binary")).mapInArrow(lambda batches: _parse_binary(batches, keep), ARTIFACTS)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, bytes | bytearray]]:
    """Files of rows (path, rel, text) sorted by path: texts joined, each with its end of line, null ones left out. A file may run over several batches."""
    held, last = bytearray(), None
    for b in batches:
        paths, rels, texts = (b.column(n) for n in ("path", "rel", "text"))
        starts = [0, *(np.flatnonzero(pc.fill_null(pc.not_equal(paths[1:], paths[:-1]), True).to_numpy(zero_copy_only=False)) + 1).tolist()] if b.num_rows else []
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            path = paths[s].as_py()
            if last is None or path != last[0]:
                if last is not None:
                    yield *last, held or b"\n"
                last, held = (path, rels[s].as_py()), bytearray()
            for text in texts[s:e].to_pylist():
                if text is not None:
                    held += text
                    held += b"\n"
    if last is not None:
        yield *last, held or b"\n"


def parse_pieces(pieces: DataFrame, keep: Collection[str] = RELATIONS) -> DataFrame:
    """Artifacts of files given in pieces (path, rel, at, text), whole lines without the last one's end, in order of at.

    For large files: pieces are sorted, so that none but the worker that reads a file holds it whole, and that one alone.
    keep: the relations whose facts are kept; the others' lists are empty.
    """
    rows = pieces.select("path", "rel", "at", F.col("text").cast("binary")).repartition("path").sortWithinPartitions("path", "at")
    return rows.select("path", "rel", "text").mapInArrow(lambda batches: _batches(_joined(batches), keep), ARTIFACTS)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rel, path in zip(b.column("rel").to_pylist(), b.column("path").to_pylist()):
            text = (_read(path) or b"").decode("utf-8", "replace").split("\n")
            n = len(text)
            yield pa.RecordBatch.from_arrays([pa.array([rel] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(text, pa.string())], ["file", "line", "text"])


def lines(paths: DataFrame) -> DataFrame:
    """(file, line, text) of every line."""
    return paths.select("rel", "path").mapInArrow(_lines, "file string, line int, text string")


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data = [_read(p) or b"" for p in b.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([len(d) for d in data], pa.int64()), pa.array([d.count(b"\n") for d in data], pa.int64())], ["path", "bytes", "lines"])


def sizes(paths: DataFrame) -> DataFrame:
    """(path, bytes, lines) of every file, without parsing it."""
    return paths.select("path").mapInArrow(_sizes, "path string, bytes long, lines long")


def input_size(artifacts: DataFrame) -> DataFrame:
    """One row: files, bytes, lines."""
    return files_of(artifacts).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
