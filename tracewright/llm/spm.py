"""SentencePiece encoding and decoding by a relational lattice of pieces.

The pieces of the model are a table (piece, id, rank). Characters that stand side by side in a piece are of one class; a
text, its spaces marks, is cut into units of one class, so that no piece reaches over a unit's end. Units of one
character, and those too long for a lattice (LONGEST characters), are known from the model; the others are encoded
in DataFrame operations, each distinct unit of the corpus once: substrings of bounded length are exploded, met with the piece
table in a broadcast equi-join (its size is the model's, and is checked), grouped by unit into the edges of its lattice, and
folded by a higher-order aggregate.

Two folds read a lattice. For a unigram model, Viterbi: the path of the greatest sum of scores. For a
BPE model that path is wrong, as BPE joins the best-scoring neighbours first; there the fold removes one
cut between neighbours at a time, best edge first, leftmost of equals. Characters that no piece covers become byte pieces.

Documents are cut into units in Arrow batches, in blocks of bounded size: a block holds its distinct units and each document's
places among them. Only block vocabularies meet the units' ids; those come back to the block (a table bucketed by
block), where each document's ids are put together and decoded. No text is shuffled.

Defined results: a null or empty text has no ids; every text decodes to itself, but that a mark U+2581 in it becomes a space
and a lone surrogate a replacement sign; repeated rows give equal rows; an empty table gives an empty table; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import ctypes
import heapq
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

MODEL, MARK = "piece_bpe_32k.model", "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: The most pieces that may be broadcast; the longest unit that takes a lattice; characters and distinct units of a block.
MOST_PIECES, LONGEST, BLOCK_CHARS, BLOCK_UNITS = 1_000_000, 48, 32_000_000, 400_000
#: A place is one number: the task, the block in it (BLOCK_BITS) and the unit in that (PLACE_BITS). Documents packed together.
#: Units whose ids a task packs together.
BLOCK_BITS, PLACE_BITS, TOGETHER, GATHERED = 12, 28, 500, 1_000_000


def _unit_pattern(plain: dict[str, int]) -> re.Pattern:
    """Characters that stand side by side in a piece are of one class, marks aside; a unit is a run of one class."""
    root: dict[str, str] = {}

    def find(c: str) -> str:
        while root.setdefault(c, c) != c:
            c = root[c]
        return c

    for p in plain:
        for a, b in zip(p, p[1:]):
            if a != MARK:
                root[find(b)] = find(a)
            elif b != MARK:
                find(b)
    classes: dict[str, list[str]] = {}
    for c in root:
        classes.setdefault(find(c), []).append(c)
    runs = [f"{MARK}*[{''.join(map(re.escape, sorted(cs)))}]+" for cs in sorted(classes.values(), key=len, reverse=True)]
    return re.compile("|".join([*runs, f"{MARK}+", "."]), re.S)


@dataclass
class Pieces:
    """The piece table. ids and scores of pieces that text can become; text of every id; ids of byte pieces."""

    ids: dict[str, int]
    scores: dict[str, float]
    bytes_of: list[bytes]
    byte_ids: list[int]
    longest: int
    #: Finds units: runs of characters that pieces join, with the marks before them; runs of marks; other characters.
    pattern: re.Pattern | None = None

    @classmethod
    def read(cls, path: str | None = None) -> Pieces:
        m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        every = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = {p: i for i, p in enumerate(every) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        if any(MARK in p.lstrip(MARK) for p in plain):
            raise ValueError("a piece reaches over the end of a word")
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        text = [p.replace(MARK, " ").encode() for p in every]
        for b, i in enumerate(byte_ids):
            text[i] = bytes([b])
        for i in range(len(every)):
            if m.is_control(i) or m.is_unknown(i):
                text[i] = b""
        if any(c not in plain for p in plain for c in p):
            raise ValueError("a character of a piece is no piece")
        return cls(plain, {p: m.get_score(i) for p, i in plain.items()}, text, byte_ids, max(map(len, plain)), _unit_pattern(plain))

    def units_in(self, text: str | None) -> list[str]:
        """The units of a text in order; no piece reaches over the end of one."""
        return self.pattern.findall(MARK + text.replace(" ", MARK)) if text else []

    def lattice(self, word: str) -> dict[tuple[int, int], float]:
        """(start, end) to score for every substring of two characters or more that is a piece."""
        get, out, n = self.scores.get, {}, len(word)
        for a in range(n - 1):
            for b in range(a + 2, min(n, a + self.longest) + 1):
                s = get(word[a:b])
                if s is not None:
                    out[a, b] = s
        return out

    def fold(self, word: str) -> list[str]:
        """The word's pieces: cuts between neighbours go, best edge first."""
        n, edges = len(word), self.lattice(word)
        if (0, n) not in edges and not edges:
            return list(word)
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        queue = [(-edges[a, a + 2], a, a + 2) for a in range(n - 1) if (a, a + 2) in edges]
        heapq.heapify(queue)
        alive = [True] * (n + 1)
        while queue:
            _, a, c = heapq.heappop(queue)
            if not (alive[a] and alive[c]):
                continue
            b = after[a]
            if b >= c or after[b] != c:
                continue
            alive[b] = False
            after[a], before[c] = c, a
            if a > 0 and (s := edges.get((before[a], c))) is not None:
                heapq.heappush(queue, (-s, before[a], c))
            if c < n and (s := edges.get((a, after[c]))) is not None:
                heapq.heappush(queue, (-s, a, after[c]))
        out, a = [], 0
        while a < n:
            out.append(word[a : after[a]])
            a = after[a]
        return out

    def word_ids(self, word: str) -> list[int]:
        out: list[int] = []
        for p in self.fold(word):
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[b] for b in p.encode("utf-8", "replace")]
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian unsigned 16-bit bytes, by the heap fold: the plain version that tests hold the lattice to."""
        return np.array([i for w in words_in(text) for i in self.word_ids(w)], "<u2").tobytes()

    def decode(self, ids: bytes) -> str:
        """The text of ids given as little-endian unsigned 16-bit bytes."""
        table = self.bytes_of
        out = b"".join([table[i] for i in np.frombuffer(ids, "<u2").tolist()]).decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out


@lru_cache(maxsize=1)
def pieces(path: str | None = None) -> Pieces:
    return Pieces.read(path)


def words_in(text: str | None) -> list[str]:
    """The words of a text: runs of marks and the characters up to the next mark, the first begun by a mark of its own."""
    if not text:
        return []
    parts = text.split(" ")
    return [MARK + p for p in parts] if MARK not in text and "" not in parts else _WORDS.findall(MARK + text.replace(" ", MARK))


# -- documents in blocks ------------------------------------------------------
_BLOCK = "block long, units array<string>, known binary, docs binary"


class _Block:
    """Distinct units and the documents' places among them. Units that need no lattice bear their ids."""

    def __init__(self, table: Pieces, number: int) -> None:
        self.table, self.number, self.place, self.known, self.docs, self.chars = table, number, {}, {}, [], 0

    def add(self, doc: int | None, text: str | None) -> None:
        units, place = self.table.units_in(text), self.place
        for u in set(units).difference(place):
            place[u] = len(place)
            if len(u) == 1 or len(u) > LONGEST:
                self.known[place[u]] = self.table.word_ids(u)
        n = len(text or "")
        same = zlib.crc32((text or "").replace(MARK, " ").encode("utf-8", "replace"))
        self.docs.append((doc, n, same, np.fromiter(map(place.__getitem__, units), "<u4", len(units))))
        self.chars += n + 1

    def row(self) -> pa.RecordBatch:
        units = [None if at in self.known else u for u, at in self.place.items()]
        docs = [self.docs[k : k + TOGETHER] for k in range(0, len(self.docs), TOGETHER)]
        docs = [([(doc, n, same, len(p)) for doc, n, same, p in some], _packed(np.concatenate([p for *_, p in some]))) for some in docs]
        data = [pickle.dumps(x, protocol=5) for x in (self.known, docs)]
        return pa.RecordBatch.from_arrays([pa.array([self.number], pa.int64()), pa.array([units], pa.list_(pa.string())), *(pa.array([d], pa.binary()) for d in data)], ["block", "units", "known", "docs"])


def _packed(places: np.ndarray) -> bytes:
    """Places as four planes of bytes, as the high ones are mostly zero."""
    return zstandard.compress(places.view("u1").reshape(-1, 4).T.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "u1").reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of n numbers each, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, ids; two bytes an id, the high one first) to rows (block, told): the ids of a block's units, packed in the order of places."""

    def out() -> pa.RecordBatch:
        place, n, ids = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(place)
        ids = ids[_spread((np.cumsum(n) - n)[order], n[order])]
        place, n = place[order], n[order]
        block, at = place >> PLACE_BITS, place & ((1 << PLACE_BITS) - 1)
        starts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
        to = np.r_[0, np.cumsum(n)]
        told = [_planes(np.diff(at[s:e], prepend=0), n[s:e], ids[to[s] : to[e]]) for s, e in zip(starts, starts[1:])]
        return pa.RecordBatch.from_arrays([pa.array(block[starts[:-1]]), pa.array(told, pa.binary())], ["block", "told"])

    held, rows = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("ids").cast(pa.binary())
        held.append((b.column("place").to_numpy(), pc.binary_length(ids).to_numpy().astype(np.int64) // 2, np.frombuffer(b"".join(ids.to_pylist()), ">u2").astype("<u2")))
        rows += b.num_rows
        if rows >= GATHERED:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def _planes(step: np.ndarray, n: np.ndarray, ids: np.ndarray) -> bytes:
    """Steps between places, numbers of ids and the ids, as planes of bytes."""
    planes = [x.astype(t).view("u1").reshape(-1, x_bytes).T.tobytes() for x, t, x_bytes in ((step, "<u4", 4), (n, "<u2", 2), (ids, "<u2", 2))]
    return zstandard.compress(len(n).to_bytes(8, "little") + b"".join(planes), 1)


def _told(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _planes packed: places, numbers of ids, ids."""
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:8], "little")
    whole = lambda a, b, t, x_bytes: np.frombuffer(data[a:b], "u1").reshape(x_bytes, -1).T.copy().view(t).ravel().astype(np.int64)
    return np.cumsum(whole(8, 8 + 4 * n, "<u4", 4)), whole(8 + 4 * n, 8 + 6 * n, "<u2", 2), whole(8 + 6 * n, len(data), "<u2", 2)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId() << BLOCK_BITS
    block = _Block(pieces(), task)
    for b in batches:
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            block.add(doc, text)
            if block.chars >= BLOCK_CHARS or len(block.place) >= BLOCK_UNITS:
                yield block.row()
                if (block.number + 1) >> BLOCK_BITS != task >> BLOCK_BITS:
                    raise ValueError("a task has too many blocks")
                block = _Block(block.table, block.number + 1)
    if block.docs:
        yield block.row()
    block = b = None
    _give_back()


def _give_back() -> None:
    """Free memory goes back to the system, as the worker waits beside the JVM while units are folded."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def _assembled(with_ids: bool):
    """Blocks (docs, known, told) to documents: told holds the ids of the units at their places, as _gathered packs them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces()
        schema = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_chars", pa.int64()), ("decoded_crc32", pa.int64()), ("round_trip", pa.bool_()), ("ids", pa.binary())])
        for b in batches:
            for k in range(b.num_rows):
                known, docs = (pickle.loads(b.column(c)[k].as_py()) for c in ("known", "docs"))
                told = [_told(x) for x in b.column("told")[k].as_py() or []]
                at, count, own_ids = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 3, *told))
                total = len(at) + len(known)
                size = np.zeros(total, np.int64)
                size[at] = count
                for p, own in known.items():
                    size[p] = len(own)
                start = np.concatenate([[0], np.cumsum(size)])
                flat = np.zeros(start[-1], np.uint16)
                flat[_spread(start[:-1][at], count)] = own_ids
                for p, own in known.items():
                    flat[start[p] : start[p + 1]] = own
                for some, packed in docs:
                    rows, places = [], _unpacked(packed)
                    ends = np.cumsum([0, *(d[3] for d in some)])
                    for (doc, n_chars, crc, _), first, end in zip(some, ends, ends[1:]):
                        p = places[first:end]
                        ids = flat[_spread(start[:-1][p], size[p])]
                        back = table.decode(ids.astype("<u2").tobytes())
                        wide, back_crc = ids.astype("<u4").tobytes(), zlib.crc32(back.encode())
                        rows.append((doc, len(ids), zlib.crc32(wide), len(back), back_crc, (n_chars, crc) == (len(back), back_crc), wide if with_ids else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    return run


def encode_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_ids, ids_crc32, decoded_chars, decoded_crc32, round_trip, and ids (unsigned 32-bit, little-endian) if asked for."""
    spark = docs.sparkSession
    blocks = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_blocks, _BLOCK), by="block", compression="zstd")
    places = blocks.select("block", F.posexplode("units").alias("at", "word")).where(F.col("word").isNotNull())
    places = places.select(F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("at")).alias("place"), "word")
    ids = encode_units(places, piece_table(spark), pieces().longest)
    back = ids.mapInArrow(_gathered, "block long, told binary").groupBy("block").agg(F.collect_list("told").alias("told"))
    whole = blocks.select("block", "known", "docs").join(back, "block", "left")
    out = whole.select("known", "docs", "told").mapInArrow(_assembled(with_ids), "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_crc32 long, round_trip boolean, ids binary")
    return out if with_ids else out.drop("ids")


def encode_units(places: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """places (place, word) with ids, two bytes each: the lattice of every distinct word, folded once.

    Places meet by word in the one exchange that words take; both branches below read it (as both use the place).
    """
    met = places.select("place", "word").repartition("word")
    words = met.groupBy("word").agg(F.min("place").alias("least")).where("least >= 0").select("word")
    ranked = table.withColumn("value", F.col("rank").cast("long") * 65536 + F.col("id"))
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(n, F.col("a") + longest))).alias("b"))
    subs = spans.withColumn("piece", F.substring("word", F.col("a") + 1, F.col("b") - F.col("a")))
    edges = subs.join(F.broadcast(ranked.select("piece", "value")), "piece").select("word", (F.col("a") * 64 + F.col("b")).alias("k"), "value")
    lattice = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("edges"))
    folded = lattice.withColumn("cuts", merged_cuts(F.col("edges"), F.length("word")))
    ends = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda a, k: F.lpad(F.hex(F.try_element_at("edges", a * 64 + F.get("cuts", k + 1)) % 65536), 4, "0"))
    ids = folded.select("word", F.unhex(F.array_join(ends, "")).alias("ids"))
    return met.join(ids, "word").select("place", "ids")


def merged_cuts(edges: Column, n: Column) -> Column:
    """The cuts 0..n that are left when neighbours are joined, least value first, leftmost of equals. edges: 64 * a + b to value, less for a better score."""
    none = F.lit(1 << 62)

    def step(cuts: Column, _: Column) -> Column:
        inner = F.when(F.size(cuts) > 2, F.sequence(F.lit(1), F.size(cuts) - 2))
        best = F.array_min(F.transform(inner, lambda k: F.coalesce(F.try_element_at(edges, F.get(cuts, k - 1) * 64 + F.get(cuts, k + 1)) * 64 + k, none)))
        without = lambda v: F.when(v < none, F.concat(F.slice(cuts, F.lit(1), (v % 64).cast("int")), F.slice(cuts, (v % 64).cast("int") + 2, F.lit(64)))).otherwise(cuts)
        return F.coalesce(F.get(F.transform(F.array(best), without), F.lit(0)), cuts)  # an array of one, so that the best is found once

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), F.sequence(F.lit(0), n), step)


# -- the same in DataFrame operations, for a table of words -----------------
def piece_table(spark: SparkSession, table: Pieces | None = None) -> DataFrame:
    """(piece, id, score, rank) of the pieces that text can become, rank by score, best first. Its size is that of the model."""
    table = table or pieces()
    if len(table.ids) > MOST_PIECES:
        raise ValueError(f"{len(table.ids)} pieces are too many to broadcast")
    rank, last = {}, None
    for p in sorted(table.ids, key=lambda p: -table.scores[p]):
        rank[p] = rank[last] if last is not None and table.scores[last] == table.scores[p] else len(rank)
        last = p
    return spark.createDataFrame([(p, i, float(table.scores[p]), rank[p]) for p, i in table.ids.items()], "piece string, id int, score double, rank int")


def edges_of(words: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(word, edges): substrings met with pieces; edges holds (a, b, id, score) for a word's substring from a to b."""
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("a"))
    spans = starts.select("word", "a", F.explode(F.sequence(F.col("a") + 1, F.least(n, F.col("a") + longest))).alias("b"))
    subs = spans.withColumn("piece", F.substring("word", F.col("a") + 1, F.col("b") - F.col("a")))
    met = subs.join(F.broadcast(table), "piece")
    return met.groupBy("word").agg(F.collect_list(F.struct("a", "b", "id", "score")).alias("edges"))


def _score(edges: Column, a: Column, b: Column) -> Column:
    return F.get(F.filter(edges, lambda e: (e["a"] == a) & (e["b"] == b)), F.lit(0))["score"]


def bpe_cuts(edges: Column, n: Column) -> Column:
    """The cuts 0..n that are left when neighbours are joined, best edge first, leftmost of equals: a higher-order aggregate over as many steps as there are inner cuts."""

    def step(cuts: Column, _: Column) -> Column:
        inner = F.when(F.size(cuts) > 2, F.sequence(F.lit(1), F.size(cuts) - 2)).otherwise(F.array().cast("array<int>"))
        joins = F.transform(inner, lambda k: F.struct(_score(edges, F.get(cuts, k - 1), F.get(cuts, k + 1)).alias("score"), (-k).alias("k")))
        best = F.array_max(F.filter(joins, lambda j: j["score"].isNotNull()))
        return F.when(best.isNull(), cuts).otherwise(F.filter(cuts, lambda c, k: k != -best["k"]))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.sequence(F.lit(0), n), step)


def viterbi_cuts(edges: Column, n: Column, unknown: float = -100.0) -> Column:
    """The cuts of the path of the greatest sum of scores; a character that no piece covers costs `unknown`. For unigram models."""
    zero = F.array(F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("back")))

    def step(best: Column, b: Column) -> Column:
        into = F.transform(F.filter(edges, lambda e: e["b"] == b), lambda e: F.struct((F.get(best, e["a"])["total"] + e["score"]).alias("total"), e["a"].alias("back")))
        skip = F.struct((F.get(best, b - 1)["total"] + F.lit(unknown)).alias("total"), (b - 1).alias("back"))
        return F.concat(best, F.array(F.array_max(F.concat(into, F.array(skip)))))

    best = F.aggregate(F.sequence(F.lit(1), n), zero, step)
    walk = lambda cuts, _: F.when(F.get(cuts, F.lit(0)) == 0, cuts).otherwise(F.concat(F.array(F.get(best, F.get(cuts, F.lit(0)))["back"]), cuts))
    return F.aggregate(F.sequence(F.lit(1), n), F.array(n), walk)


def encode_words(words: DataFrame, model: str = "bpe", table: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Distinct words (column word, marks included, not empty) to (word, cuts, ids): ids has null where a stretch is no piece and takes byte pieces."""
    spark = words.sparkSession
    table = table if table is not None else piece_table(spark)
    longest = longest or pieces().longest
    distinct = words.select("word").where(F.length("word") > 0).distinct()
    whole = distinct.join(edges_of(distinct, table, longest), "word", "left")
    edges = F.coalesce("edges", F.array().cast("array<struct<a:int,b:int,id:int,score:double>>"))
    whole = whole.withColumns({"edges": edges, "_n": F.length("word")})
    whole = whole.withColumn("cuts", (bpe_cuts if model == "bpe" else viterbi_cuts)(F.col("edges"), F.col("_n")))
    pair = F.transform(F.slice("cuts", 1, F.size("cuts") - 1), lambda a, k: F.get(F.filter("edges", lambda e: (e["a"] == a) & (e["b"] == F.get("cuts", k + 1))), F.lit(0))["id"])
    return whole.select("word", "cuts", pair.alias("ids"))
