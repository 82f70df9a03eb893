"""SimHash near-duplicates: links between fingerprints found by BK-trees.

Fingerprints: words are runs of anything but ASCII white space, lower-cased in A-Z only; shingles
are three words, repeats included, joined by spaces (a shorter text is one shingle); a bit is set
if it is set in over half of the shingles' XXH64 (seed 42). A text without words has fingerprint zero.

Two fingerprints link at 3 or fewer differing bits; classes are the connected components. A pair
within distance 3 agrees on one of four blocks of bits at least, so distinct fingerprints are dealt
into shards by the value of each block; a shard that grows beyond `shard_limit` is dealt again by the
blocks of its other bits, and so on. Each shard builds one BK-tree, whose edges bear Hamming
distances, follows only edges within the radius, and emits one link per fingerprint at most, to
the root of its local class: never all pairs. No link between different fingerprints is lost.

Defined results: a null text is empty; repeated rows share a class; rows of null doc_id have a
fingerprint and the class of their links (null if no linked row has an id); an empty table gives an empty table;
columns other than doc_id and text are ignored.

The pipeline's stage takes five words and links two texts if the sets of their shingles have a Jaccard
similarity of 0.8 or more. Such pairs differ in about ten of 64 bits, so blocks of equal bits cannot deal them
into shards. A prefix filter does, and loses no pair: in any common order of shingles two such sets share
one among the first fifth of each. Each shard (a shingle) builds a BK-tree of its members' fingerprints
and follows edges within WIDE bits (WIDEST for small sets); what it finds is confirmed on the sets. The radius is the
method's own bound: of the pairs of similarity 0.8 or more, some one in ten thousand differs in more bits. Crowded shards
first offer only each member's nearest; after those are confirmed, only pairs of unlike class are
compared there, in blocks of members, so that a group of copies is never paired with itself: again the nearest,
as long as that joins classes, and at last all that are of unlike class still.
The order of shingles comes from a sample that is a share of the documents (rare ones first); it bears on the work, not on the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, cut

RADIUS, BITS, SEED, SHINGLE = 3, 64, 42, 3
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


#: The stage's shingle and radius, the members that a shard pairs at once, the nearest that a crowded one offers,
#: the members of a block of it, and the documents that the order of shingles is made from: as many or this share of them, whichever is more.
WORDS, CROWD, NEAREST, BLOCK, SAMPLED, SHARE = 5, 16, 2, 2048, 8192, 0.2
#: Rounds, at most, in which crowded shards offer the nearest members of unlike class before all that are left.
ROUNDS = 2
#: Radii: of sets of SMALL shingles or more, and of smaller ones, whose fingerprints are less steady.
WIDE, WIDEST, SMALL = 20, 28, 32


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned number."""
    hashes = shingles(text, SHINGLE)
    return _majority(hashes) if len(hashes) else 0


def shingles(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of size words, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    last = (ends[size - 1 :] - 1).tolist()
    first = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], dtype="<u8")


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id (long) and fp (the fingerprint's bits as a signed long) of every document."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def blocks(n_bits: int) -> list[tuple[int, int]]:
    """Four (start, width) blocks over n_bits free bits."""
    at = [n_bits * i // (RADIUS + 1) for i in range(RADIUS + 2)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


class BKTree:
    """Children keyed by integer Hamming distance to the parent; nodes are indices of the values added."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """The indices within radius of value among those added before; then adds value."""
        new, found = len(self.values), []
        self.values.append(value)
        self.children.append({})
        if not new:
            return found
        stack, values, children = [0], self.values, self.children
        while stack:
            node = stack.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        node = 0
        while True:
            d = (values[node] ^ value).bit_count()
            child = children[node].get(d)
            if child is None:
                children[node][d] = new
                return found
            node = child


class BKIndex:
    """The same tree over an array of distinct or equal 64-bit values, built and searched a level at a time for many queries."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        n = len(values)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        left, at = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)  # values without a node, and the node each has come to
        while len(left):
            d = np.bitwise_count(values[left] ^ values[at]).astype(np.int64)
            _, first, group = np.unique(at * (BITS + 1) + d, return_index=True, return_inverse=True)
            node = left[first]
            parent[node], edge[node] = at[first], d[first]
            at = node[group]
            rest = left != at
            left, at = left[rest], at[rest]
        self.children = np.argsort(parent, kind="stable")[1:]
        self.edge = edge[self.children]
        self.begin = np.searchsorted(parent[self.children], np.arange(n + 1))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, value number, distance) of all within radius."""
        q, node, found = np.arange(len(queries)), np.zeros(len(queries), np.int64), []
        while len(q) and len(self.values):
            d = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            found.append((q[hit], node[hit], d[hit]))
            n = self.begin[node + 1] - self.begin[node]
            child = np.repeat(self.begin[node] - np.cumsum(n) + n, n) + np.arange(n.sum())
            q, d = np.repeat(q, n), np.repeat(d, n)
            near = np.abs(self.edge[child] - d) <= radius
            q, node = q[near], self.children[child[near]]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def _in_chunks(tree: BKIndex, queries: np.ndarray, radius: int, most: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """BKIndex.within for so many queries at a time that what they visit stays small."""
    step = max(1, most // max(1, len(tree.values)))
    for at in range(0, len(queries), step):
        q, v, d = tree.within(queries[at : at + step], radius)
        yield q + at, v, d


def _links(values: list[int]) -> Iterator[tuple[int, int]]:
    """(value, root) for each value that is not its local class's first: links enough to connect each class."""
    if len(values) == 2:
        if (values[0] ^ values[1]).bit_count() <= RADIUS:
            yield values[1], values[0]
        return
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)

    if len(values) <= 64:
        tree = BKTree()
        for i, v in enumerate(values):
            for j in tree.add_and_find(v, RADIUS):
                join(i, j)
    else:
        table = np.array(values, np.uint64)
        for q, v, _ in _in_chunks(BKIndex(table), table, RADIUS):
            for i, j in zip(q[v < q].tolist(), v[v < q].tolist()):
                join(i, j)
    for i, v in enumerate(values):
        if (r := root(i)) != i:
            yield v, values[r]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard; a shard may run over several batches."""

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    last, held = None, []
    for b in batches:
        keys, fps = b.column("shard").to_numpy(zero_copy_only=False), b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        pairs: list[tuple[int, int]] = []
        starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        numbers = fps.tolist()
        for s, e in zip(starts, starts[1:]):
            if keys[s] != last:
                if len(held) > 1:
                    pairs += _links(held)
                last, held = keys[s], []
            held += numbers[s:e]
        if pairs:
            yield out(pairs)
    if len(held) > 1 and (pairs := list(_links(held))):
        yield out(pairs)


def _field(mask: Column, start: int, width: int) -> Column:
    return F.call_function("shiftrightunsigned", mask, F.lit(start)).bitwiseAND(F.lit((1 << width) - 1))


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """One row per block for each row of (path, rest, n_free, fp): the shard is known by path, level, block and value.

    rest holds the bits not fixed yet, packed together; n_free of them.
    """
    n_free = BITS
    for _ in range(level):
        n_free -= n_free // (RADIUS + 1)
    dealt = []
    for k, (start, width) in enumerate(blocks(n_free)):
        value = _field(F.col("rest"), start, width)
        low = F.col("rest").bitwiseAND(F.lit((1 << start) - 1)) if start else F.lit(0).cast("long")
        high = F.call_function("shiftrightunsigned", F.col("rest"), F.lit(start + width)) if start + width < 64 else F.lit(0).cast("long")
        left = F.call_function("shiftleft", high, F.lit(start)).bitwiseOR(low)
        dealt.append(F.struct(F.xxhash64("path", F.lit(level), F.lit(k), value).alias("path"), left.alias("rest")))
    return rows.select("fp", F.explode(F.array(*dealt)).alias("_s")).select("fp", "_s.*")


def links(fps: DataFrame, shard_limit: int = 256, max_level: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints (column fp) that connect all pairs within the radius, and no others.

    After four levels a shard's values agree in 43 bits or more, so none can exceed 2 ** 21 values.
    """
    rows = fps.select("fp", F.lit(0).cast("long").alias("path"), F.col("fp").alias("rest"))
    spark, found = fps.sparkSession, None
    for level in range(max_level):
        dealt = _deal(rows, level)
        sizes = dealt.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(sizes.where(F.col("n") > shard_limit).select("path"))
        many = hot.count() if level + 1 < max_level else 0
        calm = dealt.join(hot, "path", "left_anti") if many else dealt
        got = calm.withColumnRenamed("path", "shard").repartition("shard").sortWithinPartitions("shard", "fp").select("shard", "fp").mapInArrow(_shards, "a long, b long")
        found = got if found is None else found.unionByName(got)
        if not many:
            break
        rows = cut(dealt.join(hot, "path", "left_semi").select("fp", "path", "rest"))
    return found


def near_duplicates(docs: DataFrame, shard_limit: int = 256) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable over links)."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    return _named(prints, distinct, components(links(distinct.select("fp"), shard_limit)))


def _named(prints: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """prints with component_id, from the classes (node, root) of their fingerprints."""
    named = roots.join(distinct, roots["node"] == distinct["fp"]).groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    by_fp = distinct.join(of, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return prints.join(cut(by_fp), "fp")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# -- Jaccard similarity of the sets of shingles --------------------------------
def _key(own: np.ndarray) -> int:
    """One number per set; the empty set's is zero."""
    return xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [np.unique(shingles(t, WORDS)) for t in b.column("text").to_pylist()]
        t, n = np.unique(np.concatenate([np.zeros(0, "<u8"), *own]), return_counts=True)
        yield _table(t=pa.array(t.view("<i8")), n=pa.array(n, pa.int64()))


def common_shingles(docs: DataFrame, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts) of those that a sample of documents holds often, sorted by shingle. They order the work; results don't depend on them.

    The sample is a share of the documents: one of fixed size knows ever fewer of the shingles that make a crowded shard.
    """
    share = max(SHARE, min(1.0, SAMPLED / max(1, docs.count())))
    picked = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    counted = cut(picked.mapInArrow(_in_parts(_sampled), "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where("n > 2"))
    sizes = sorted(((r["n"], r["m"]) for r in counted.groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()), reverse=True)
    told = np.cumsum([m for _, m in sizes])
    least = next((n + 1 for (n, _), total in zip(sizes, told) if total > most), 0)
    found = counted.where(F.col("n") >= least).toArrow()
    t, n = found.column("t").to_numpy().view(np.uint64), found.column("n").to_numpy()
    at = np.argsort(t)
    return t[at], n[at]


def _prefixes(common: np.ndarray, counts: np.ndarray):
    """doc_id, key (the set's number), fp (its fingerprint), n (its size) and the first shingles of the set, of which any set with 0.8 of its union shares one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, fps, sizes, first = [], [], [], []
            for t in b.column("text").to_pylist():
                own = np.unique(shingles(t, WORDS))
                n = len(own)
                rank = np.zeros(n, np.int64)
                if len(common) and n:
                    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
                    rank = np.where(common[at] == own, counts[at], 0)
                keys.append(_key(own))
                fps.append(_majority(own) if n else 0)
                sizes.append(n)
                first.append(own[np.lexsort((own, rank))][: n - (4 * n + 4) // 5 + 1 if n else 0])
            numbers = [pa.array(np.array(x, dtype="<u8").view("<i8"), pa.int64()) for x in (keys, fps)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *numbers, pa.array(sizes, pa.int32()), _lists(first)], ["doc_id", "key", "fp", "n", "first"])

    return run


def _may_reach(n: np.ndarray, pos: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets x and y (numbers into n and pos) can have a similarity of 0.8 by their sizes and by what follows
    their shingle: an upper bound where that is the first shingle that both have."""
    small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
    return (5 * small >= 4 * large) & (9 * np.minimum(n[x] - pos[x], n[y] - pos[y]) >= 4 * (n[x] + n[y]))


def _few(rows: list[tuple[int, int, int, int]], told: set[tuple[int, int]]) -> None:
    """Candidates of a shard of few members (key, fp, n, pos)."""
    for i, (a, f, m, p) in enumerate(rows):
        for b, g, n, q in rows[:i]:
            if (f ^ g).bit_count() <= (WIDE if min(m, n) >= SMALL else WIDEST) and 5 * min(m, n) >= 4 * max(m, n) and 9 * min(m - p, n - q) >= 4 * (m + n):
                told.add((a, b) if a > b else (b, a))


def _crowd(key: np.ndarray, fp: np.ndarray, n: np.ndarray, pos: np.ndarray, kind: np.ndarray | None, side: np.ndarray | None, nearest: bool = True) -> Iterator[np.ndarray]:
    """Candidates of a crowded shard as rows (larger key, smaller key): the nearest few of each member, or all.

    kind None: in blocks of like fingerprints. Else only pairs of unlike kind; side: where it differs within the
    shard, only pairs of unlike side.
    """
    radius = WIDE if n.min() >= SMALL else WIDEST
    order = np.argsort(fp, kind="stable") if kind is None else np.arange(len(fp))
    for at in range(0, len(order), BLOCK if kind is None else len(order)):
        part = order[at : at + BLOCK] if kind is None else order
        for q, v, d in _in_chunks(BKIndex(fp[part]), fp[part], radius):
            x, y = part[q], part[v]
            ok = (key[x] != key[y] if nearest else key[x] > key[y]) & _may_reach(n, pos, x, y)
            if kind is not None:
                ok &= kind[x] != kind[y]
            if side is not None and side.min() != side.max():
                ok &= side[x] != side[y]
            x, y, d = x[ok], y[ok], d[ok]
            if nearest and len(x):
                by = np.lexsort((key[y], d, x))
                x, y = x[by], y[by]
                start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                nth = np.arange(len(x)) - np.repeat(start, np.diff(np.r_[start, len(x)]))
                x, y = x[nth < NEAREST], y[nth < NEAREST]
            yield np.unique(np.stack([np.maximum(key[x], key[y]), np.minimum(key[x], key[y])], axis=1), axis=0)


def _groups(batches: Iterator[pa.RecordBatch], by: str, names: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each run of equal `by` that has two rows or more; a run may go over several batches."""
    held: list[list[np.ndarray]] = []

    def whole() -> list[np.ndarray]:
        return held[0] if len(held) == 1 else [np.concatenate(c) for c in zip(*held)]

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(by).to_numpy(zero_copy_only=False)
        columns = [b.column(x).to_numpy(zero_copy_only=False) for x in names]
        starts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        if held and held[-1][0][-1] != keys[0]:
            if sum(len(c[0]) for c in held) > 1:
                yield whole()[1:]
            held = []
        ends = np.flatnonzero((np.diff(starts)[:-1] > 1) | bool(held)) if len(starts) > 2 else []
        for k in ends:
            s, e = starts[k], starts[k + 1]
            part = [keys[s:e], *(c[s:e] for c in columns)]
            if k == 0 and held:
                held.append(part)
                yield whole()[1:]
                held = []
            elif e - s > 1:
                yield part[1:]
        s = starts[-2]
        last = [keys[s:].copy(), *(c[s:].copy() for c in columns)]
        held = [*held, last] if held and len(starts) == 2 else [last]
    if held and sum(len(c[0]) for c in held) > 1:
        yield whole()[1:]


def _table(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (t, key, pos) sorted by t those whose t two or more have, with m, how many."""
    for t, key, pos in _groups(batches, "t", ["t", "key", "pos"]):
        yield _table(t=pa.array(t), key=pa.array(key), pos=pa.array(pos, pa.int32()), m=pa.array(np.full(len(t), len(t), np.int64)))


def _first_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp, n, pos) sorted by t to pairs (a, b): all of a shard of few, of a crowded one the nearest."""
    told: set[tuple[int, int]] = set()

    def pairs(both: np.ndarray) -> pa.RecordBatch:
        return _table(a=pa.array(both[:, 0], pa.int64()), b=pa.array(both[:, 1], pa.int64()))

    for key, fp, n, pos in _groups(batches, "t", ["key", "fp", "n", "pos"]):
        if len(key) <= CROWD:
            _few(list(zip(key.tolist(), fp.view(np.uint64).tolist(), n.tolist(), pos.tolist())), told)
        else:
            for both in _crowd(key, fp.view(np.uint64), n, pos, None, None):
                yield pairs(both)
        if len(told) > 20_000:
            yield pairs(np.array(list(told), np.int64))
            told.clear()
    if told:
        yield pairs(np.array(list(told), np.int64))


def _more_candidates(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """Rows (shard, t, key, fp, n, pos, class, side) sorted by shard and t to pairs (a, b), once each, of unlike class that share a t, and, in a shard of two blocks, of unlike side. nearest: the nearest of each member alone."""
    for t, *columns in _groups(batches, "shard", ["t", "key", "fp", "n", "pos", "class", "side"]):
        found = np.zeros((0, 2), np.int64)
        starts = np.r_[0, np.flatnonzero(t[1:] != t[:-1]) + 1, len(t)]
        for s, e in zip(starts, starts[1:]):
            if e - s > 1:
                key, fp, n, pos, kind, side = (c[s:e] for c in columns)
                for both in _crowd(key, fp.view(np.uint64), n, pos, kind, side, nearest):
                    found = np.unique(np.concatenate([found, both]), axis=0)
        if len(found):
            yield _table(a=pa.array(found[:, 0], pa.int64()), b=pa.array(found[:, 1], pa.int64()))


def _in_parts(f, rows: int = 500):
    """f over small slices, as sets of a whole batch would be large."""
    return lambda batches: f(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def _lists(own: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, "<i8"), *(x.view("<i8") for x in own)]), pa.int64()))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [np.unique(shingles(t, WORDS)) for t in b.column("text").to_pylist()]
        keys = np.array([_key(x) for x in own], dtype="<u8").view("<i8")
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _lists(own)], ["key", "own"])


def _confirm(docs: DataFrame, distinct: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sets have a Jaccard similarity of 0.8 or more. Sets are made again, of one document each; where all of a set's have no id, of all without."""
    used = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    ids = distinct.join(used, "key", "left_semi").select(F.col("first_id").alias("doc_id"))
    texts = docs.join(ids, "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull())).select("text")
    sets = cut(texts.mapInArrow(_in_parts(_whole), "key long, own array<long>").groupBy("key").agg(F.first("own").alias("own")))
    x, y = (sets.select(F.col("key").alias(k), F.col("own").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    return cut(pairs.join(x, "a").join(y, "b").where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def _dealt(crowds: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of crowded shards that hold more than one class, dealt into shards of one block or of two, so that each pair of blocks meets once.

    Shingles whose smallest member is the same mostly have the same members (copies of one text): they share a
    shard, so that a pair comes out of it once.
    """
    left = crowds.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = left.groupBy("t").agg(F.min("class").alias("_c"), F.max("class").alias("_d"), F.min("key").alias("least")).where("_c < _d").select("t", "least")
    left = left.join(mixed, "t")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("key"), blocks).cast("int")
    spread = left.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return spread.select(F.xxhash64("least", blocks, F.least("side", "other"), F.greatest("side", "other")).alias("shard"), "t", "key", "fp", "n", "pos", "class", "side")


def similar_texts(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (the set's number), component_id (the smallest doc_id reachable over pairs of similarity 0.8 or more)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(docs.mapInArrow(_in_parts(_prefixes(*common_shingles(docs))), "doc_id long, key long, fp long, n int, first array<long>"))
    distinct = cut(rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("n").alias("n")))
    at = rows.groupBy("key").agg(F.first("first").alias("first")).select("key", F.posexplode("first").alias("pos", "t"))
    dealt = at.select("t", "key", "pos").repartition("t").sortWithinPartitions("t")
    shared = dealt.mapInArrow(_shared, "t long, key long, pos int, m long")
    members = cut(shared.join(distinct.select("key", "fp", "n"), "key"))
    shards = members.select("t", "key", "fp", "n", "pos").repartition("t").sortWithinPartitions("t")
    pairs = cut(shards.mapInArrow(_first_candidates, "a long, b long").distinct())
    classes, crowds = components(_confirm(docs, distinct, pairs)), members.where(F.col("m") > CROWD)
    if not crowds.isEmpty():
        classes, near, done = cut(classes), ROUNDS > 0, 0
        while True:  # the nearest of unlike class as long as that joins classes; then all that are of unlike class still
            of = classes.select(F.col("node").alias("key"), F.col("root").alias("class"))
            shards = _dealt(crowds, of).repartition("shard").sortWithinPartitions("shard", "t")
            more = cut(shards.mapInArrow(partial(_more_candidates, nearest=near), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"))
            good = _confirm(docs, distinct, more)
            classes, pairs, done = cut(_merged(classes, good)), pairs.unionByName(more), done + 1
            if not near:
                break
            near = done < ROUNDS and not good.isEmpty()
    firsts = distinct.select(F.col("key").alias("fp"), "first_id")
    return _named(rows.select("doc_id", F.col("key").alias("fp")), firsts, classes)


def _merged(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, root) with those joined that links (a, b) between their nodes connect; only links between classes are contracted."""
    at = lambda side: classes.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    ends = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    tops = components(ends).select(F.col("node").alias("root"), F.col("root").alias("top"))
    below = classes.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return below.unionByName(tops.select(F.col("root").alias("node"), F.col("top").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class of similar texts, that of the smallest doc_id, stays.

    Rows without an id stay; of rows that repeat a kept id one stays, chosen by text. Columns may have any names.
    """
    keep = cut(similar_texts(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").alias("t"))
    kept = rows.join(keep.withColumnRenamed("doc_id", "id"), "id", "left_semi")
    nth = F.row_number().over(W.partitionBy("id").orderBy("t"))
    one = kept.withColumn("nth", nth).where("nth = 1")
    return one.select("row.*").unionByName(rows.where("id is null").select("row.*"))
