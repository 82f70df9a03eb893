"""Best-fit packing of token pieces by patterns and non-negative least squares.

The histogram of piece lengths (1024 numbers at most, whatever the corpus) goes to the driver. It
enumerates patterns of up to three lengths that fill a sequence exactly, fits how often to repeat
each by non-negative least squares, rounds a share of that, takes what the counts allow, and packs the
residual histogram by best fit, longest first; of a few shares, half at least, the best is taken. The plan maps each rank of a length to a sequence and an
offset; pieces learn their rank from bucketed windows and meet the plan in one broadcast join.

Defined results: a null text is empty and has the one end token; repeated rows are packed once
each; rows of null doc_id are packed like others; an empty table gives no sequences; columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dense_rank_rows
from .tokens import encoder

SIZE, END = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def cuts(n: int, size: int = SIZE) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, after a first that may be shorter."""
    first = n % size or min(n, size)
    yield 0, first
    for start in range(first, n, size):
        yield start, size


def _cutter(with_ids: bool, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                rows: list[tuple] = []
                for doc, data in zip(b.column("doc_id").to_pylist(), encoder().encode(b.column("text").to_pylist())):
                    ids = np.frombuffer(data + END.to_bytes(2, "little"), "<u2").astype("<u4")
                    for k, (start, n) in enumerate(cuts(len(ids), size)):
                        part = ids[start : start + n].tobytes()
                        rows.append((doc, k, start, n, zlib.crc32(part), part if with_ids else None))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)

    return run


def pieces(docs: DataFrame, with_ids: bool = False, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and ids (unsigned 32-bit, little-endian) if asked for."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cutter(with_ids, size), PIECES)


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All (a >= b >= c) with a + b + c = size, c or b and c maybe 0, of lengths that occur."""
    occurs = np.zeros(size + 1, bool)
    occurs[lengths] = True
    occurs[0] = True
    a, b = np.meshgrid(np.flatnonzero(occurs), np.flatnonzero(occurs), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = size - a - b
    ok = (a >= b) & (b >= c) & (c >= 0) & (a > 0)
    a, b, c = a[ok], b[ok], c[ok]
    keep = occurs[c]
    return np.stack([a[keep], b[keep], c[keep]], axis=1)


def fit(counts: np.ndarray, table: np.ndarray, rounds: int = 80, at_once: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Active-set NNLS: (pattern numbers, repeat counts) that make the patterns' lengths come near the counts.

    Each round adds the patterns of steepest descent that share no length, solves for the passive
    set, and steps back to the boundary where a count would be negative.
    """
    goal, chosen, x = counts.astype(float), np.zeros(0, int), np.zeros(0)
    goal[0] = 0
    m, gram = np.zeros((len(counts), 0)), np.zeros((0, 0))
    for _ in range(rounds):
        rest = goal.copy()
        for k in range(3):
            np.subtract.at(rest, table[chosen, k], x)
        rest[0] = 0
        slope = rest[table].sum(axis=1)
        slope[chosen] = -np.inf
        used, new = set(), []
        for p in np.argsort(-slope)[: at_once * 20]:
            if slope[p] <= 0.5 or len(new) >= at_once:
                break
            own = set(table[p].tolist()) - {0}
            if not own & used:
                used |= own
                new.append(p)
        if not new:
            break
        chosen, x = np.append(chosen, new).astype(int), np.append(x, np.zeros(len(new)))
        more = np.zeros((len(counts), len(new)))
        for k in range(3):
            np.add.at(more, (table[new, k], np.arange(len(new))), 1.0)
        more[0] = 0
        cross = m.T @ more
        gram = np.block([[gram, cross], [cross.T, more.T @ more]])
        m = np.concatenate([m, more], axis=1)
        while len(chosen):
            best = np.linalg.solve(gram + 1e-6 * np.eye(len(chosen)), m.T @ goal)
            if (best > 1e-9).all():
                x = best
                break
            bad = best <= 1e-9
            step = (x[bad] / np.maximum(x[bad] - best[bad], 1e-12)).min()
            x = x + step * (best - x)
            stay = (x > 1e-9) & ~(bad & (x <= 1e-6))
            if stay.all():
                stay[np.flatnonzero(bad)[np.argmin(x[bad])]] = False
            chosen, x, m, gram = chosen[stay], x[stay], m[:, stay], gram[np.ix_(stay, stay)]
    return chosen, x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) for a histogram: longest first, each into the fullest sequences that have room."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                each = min(left, size // length)
                n = left // each
                room.setdefault(size - each * length, []).append(((length,) * each, n))
                left -= n * each
                continue
            held, n = room[free].pop()
            took = min(n, left)
            if took < n:
                room[free].append((held, n - took))
            if not room[free]:
                del room[free]
            room.setdefault(free - length, []).append(((*held, length), took))
            left -= took
    return [x for group in room.values() for x in group]


#: Shares of the fitted counts that are tried; what a share leaves goes to best fit, which needs some short pieces to fill gaps.
SHARES = (1.0, 0.97, 0.94, 0.9, 0.85, 0.8, 0.7, 0.6, 0.5)


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every counted length exactly as often as it occurs. counts[length] up to counts[size].

    The fit is made once; the share of it is taken that needs the fewest sequences in all.
    """
    left, whole = counts.astype(np.int64).copy(), []
    if left[size]:
        whole.append(((size,), int(left[size])))
        left[size] = 0
    table = patterns(np.flatnonzero(left), size)
    if not len(table):
        return whole + best_fit(left, size)
    chosen, x = fit(left, table)
    order, best = np.argsort(-x), None
    for share in SHARES:
        rest, out = left.copy(), []
        for i in order:
            pattern = tuple(v for v in table[chosen[i]].tolist() if v)
            need = {v: pattern.count(v) for v in pattern}
            n = min(int(x[i] * share + 0.5), *(int(rest[v]) // m for v, m in need.items()))
            if n > 0:
                for v, m in need.items():
                    rest[v] -= n * m
                out.append((pattern, n))
        out += best_fit(rest, size)
        if best is None or sum(n for _, n in out) < sum(n for _, n in best):
            best = out
    return whole + best


def pack(rows: DataFrame, size: int = SIZE) -> DataFrame:
    """rows (with doc_id, piece, length, ids_crc32) with sequence_id and offset added: a place in a sequence for every piece."""
    spark = rows.sparkSession
    hist = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(size + 1, np.int64)
    for length, n in hist.items():
        counts[length] = n
    places, cursor, base = [], np.zeros(size + 1, np.int64), 0
    for pattern, n in plan(counts, size):
        offset = 0
        for length in pattern:
            places.append((length, int(cursor[length]), int(cursor[length]) + n, base, offset))
            cursor[length] += n
            offset += length
        base += n
    plan_df = F.broadcast(spark.createDataFrame(places, "_length long, _from long, _to long, _base long, offset long"))
    order = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    buckets = F.broadcast(spark.createDataFrame([(k, isqrt(int(counts[k])) + 1) for k in range(1, size + 1)], "length long, _buckets int"))
    ranked = dense_rank_rows(rows.join(buckets, "length"), ["length"], order, F.col("_buckets"))
    out = ranked.join(plan_df, (F.col("length") == F.col("_length")) & (F.col("rn") >= F.col("_from")) & (F.col("rn") < F.col("_to")))
    return out.withColumn("sequence_id", F.col("_base") + F.col("rn") - F.col("_from")).select(*rows.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, with_ids: bool = False, size: int = SIZE) -> DataFrame:
    """Tokenise, cut and pack whole documents. The pieces are written once to the shared folder, so no text is encoded twice."""
    rows = pieces(docs, with_ids, size)
    return pack(cut(rows if with_ids else rows.drop("ids")), size)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last one; one row per piece with its place."""
    return pack_documents(docs)
