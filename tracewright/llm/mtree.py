"""Exact top-k by inner product with sharded M-trees and best-first search.

Integer vectors get one more component, sqrt(M - |x|^2) with M the largest squared norm, so
that the largest inner product is the smallest Euclidean distance. Pivots of a bounded sample are the
tree's top level: a vector belongs to the cell of its nearest pivot, and cells of many vectors are split evenly into
shards. Each shard is one M-tree: pages of routing entries with a pivot, a covering
radius and the distance to the parent's pivot, and leaf pages whose entries hold their distance to
the page's pivot. A search takes pages by their lower bound, best first; before any distance is computed, the
stored distances and the triangle inequality rule out entries (|d(q,p) - d(x,p)| > reach). Floating
bounds carry a margin in proportion to the vectors, and scores are exact integers, so results are exact, ties included.

A query first asks one shard of its nearest cell; the score of its k-th best there then rules out cells whose ball
lies too far, and it goes once to each shard that is left. Queries go in blocks, so a task holds one
shard and one block, both bounded. Each gives its k best for each query, and a window merges them.
Of equal vectors only the k + 1 smallest ids can be in an answer; others are left out before anything is dealt.

Defined results: a vector that is null or holds a null or non-finite component takes no part; rows of null id take
no part. Vectors of unlike length are compared as if the shorter went on in zeros; an empty vector scores 0
with all. Scores beyond 64 bits rank by their true value and are told as the nearest 64-bit number. Equal vectors
are all candidates, and a query leaves out candidates of its own id only; ties go to the smaller id; fewer than
k candidates give them all; an empty table gives an empty table. Rows equal in id and vector count once; other
rows that repeat an id count as that many candidates; as a query such an id asks once, with its least vector.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

FANOUT, LEAF, MARGIN = 16, 256, 1e-6
SHARD_ROWS, BLOCK_ROWS = 8192, 8192
#: Vectors that pivots are chosen from, pivots at most, the longest vectors that pivots are used for, and the largest
#: component that distances are computed for; vectors beyond it are compared one by one.
SAMPLED, PIVOTS, WIDEST, LARGEST = 2048, 256, 4096, 1e100
FACTOR = 1024


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * component), as floats that hold it exactly, or as Python integers where that overflows."""
    with np.errstate(over="ignore"):
        v = np.floor(x * float(FACTOR))
    if np.isfinite(v).all():
        return v
    return np.array([int(np.floor(c * FACTOR)) if abs(c) < 1e300 else int(c) * FACTOR for c in x.ravel().tolist()], dtype=object).reshape(x.shape)


def _floats(v: np.ndarray) -> np.ndarray:
    """Whole numbers as floats within LARGEST."""
    if v.dtype == object:
        top = int(LARGEST)
        v = np.array([max(-top, min(top, c)) for c in v.ravel().tolist()], float).reshape(v.shape)
    return np.clip(v, -LARGEST, LARGEST)


def _dots(vectors: np.ndarray, query: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of integer-valued rows of components within most: by floats where no sum can leave 53 bits, else by Python integers."""
    if not vectors.size or not query.size:
        return np.zeros(len(vectors), np.int64)
    if vectors.dtype != object and query.dtype != object and most * float(np.abs(query).max()) * len(query) < 2.0**53:
        return (vectors @ query).astype(np.int64)
    own = [int(c) for c in query.tolist()]
    out = np.empty(len(vectors), dtype=object)
    out[:] = [sum(int(a) * b for a, b in zip(row, own)) for row in vectors.tolist()]
    return out


class MTree:
    """An M-tree over integer-valued vectors with their ids; equal vectors are one entry with all its ids, smallest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, seed: int = 3) -> None:
        self.rng = np.random.default_rng(seed)
        vectors = vectors if vectors.dtype == object else vectors.astype(float)
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.dtype != object else np.array(sorted(range(len(ids)), key=lambda i: (vectors[i].tolist(), ids[i])))
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.vectors = vectors[first]
        self.ids = np.split(ids, first[1:])
        self.width = vectors.shape[1]
        huge = (np.abs(self.vectors) >= LARGEST).any(axis=1).astype(bool) if self.vectors.size else np.zeros(len(first), bool)
        self.largest = float(np.abs(self.vectors).max(initial=0.0)) if self.vectors.dtype != object else np.inf
        #: Entries that no distance is computed for.
        self.far = np.flatnonzero(huge)
        near = np.flatnonzero(~huge)
        plain = np.zeros(self.vectors.shape, float)
        plain[near] = self.vectors[near].astype(float)
        norms = (plain**2).sum(axis=1)
        self.most = float(norms.max(initial=0.0))
        self.points = np.concatenate([plain, np.sqrt(np.maximum(0.0, self.most - norms))[:, None]], axis=1)
        #: A page: (pivot, radius, is_leaf, entry numbers or child pages, distances to the pivot, the children's radii).
        self.pages: list[tuple] = []
        self.computed = 0
        self.root = self._build(near, int(near[0])) if len(near) else None

    def _distances(self, at: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.points[at] - self.points[pivot]) ** 2).sum(axis=1))

    def _build(self, at: np.ndarray, pivot: int) -> int:
        d = self._distances(at, pivot)
        if len(at) <= LEAF:
            order = np.argsort(d, kind="stable")
            self.pages.append((pivot, float(d.max()), True, at[order], d[order], None))
            return len(self.pages) - 1
        pivots = [int(at[np.argmax(d)])]
        near = self._distances(at, pivots[0])
        while len(pivots) < min(FANOUT, -(-len(at) // (LEAF // 2))):
            pool = self.rng.choice(len(at), min(len(at), 32), replace=False)
            pivots.append(int(at[pool[np.argmax(near[pool])]]))
            near = np.minimum(near, self._distances(at, pivots[-1]))
        pivots = sorted(set(pivots))
        to = np.stack([self._distances(at, p) for p in pivots])
        part = to.argmin(axis=0)
        if len(np.unique(part)) == 1:
            part = np.arange(len(at)) % 2
            pivots = [int(at[0]), int(at[1])]
        children = [self._build(at[part == k], pivots[k]) for k in np.unique(part)]
        from_pivot = self._distances(np.array([self.pages[c][0] for c in children]), pivot)
        radii = np.array([self.pages[c][1] for c in children])
        self.pages.append((pivot, float(d.max()), False, np.array(children), from_pivot, radii))
        return len(self.pages) - 1

    def search(self, query: np.ndarray, k: int, leave_out: int | None = None, floor: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id): by score, then smaller id. query: integer-valued. floor: scores below it need not be found."""
        own = query if query.dtype == object else query.astype(float)
        own = own[: self.width]
        if len(own) < self.width:
            own = np.concatenate([own, np.zeros(self.width - len(own), own.dtype)])
        heap: list[tuple[int, int]] = []  # of (score, -id), the worst first

        def take(at: np.ndarray) -> None:
            scores = _dots(self.vectors[at], own, self.largest)
            if len(heap) == k:
                some = np.flatnonzero(scores >= heap[0][0])
                at, scores = at[some], scores[some]
            for i in np.argsort(-scores, kind="stable").tolist():
                s = int(scores[i])
                if len(heap) == k and s < heap[0][0]:
                    break
                for v in self.ids[at[i]].tolist():
                    if v == leave_out:
                        continue
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    elif (s, -v) > heap[0]:
                        heapq.heapreplace(heap, (s, -v))
                    else:
                        break

        take(self.far)
        if self.root is not None and (own.dtype == object or float(np.abs(own).max(initial=0.0)) >= LARGEST):
            take(np.flatnonzero(~np.isin(np.arange(len(self.vectors)), self.far)))
        elif self.root is not None:
            self._best_first(own, k, heap, take, floor)
        return [(s, -v) for s, v in sorted(heap, key=lambda x: (-x[0], -x[1]))]

    def _best_first(self, own: np.ndarray, k: int, heap: list, take, floor: int | None) -> None:
        q = np.append(own, 0.0)
        base = float((own**2).sum()) + self.most
        slack = MARGIN * np.sqrt(base) + MARGIN
        known = lambda s: np.sqrt(max(0.0, base - 2.0 * float(s))) * (1 + MARGIN) + slack
        reach = np.inf if floor is None else known(floor)
        if len(heap) == k:
            reach = min(reach, known(heap[0][0]))

        def to(at: np.ndarray) -> np.ndarray:
            self.computed += len(at)
            return np.sqrt(((self.points[at] - q) ** 2).sum(axis=1))

        pivot = self.pages[self.root][0]
        d = float(to(np.array([pivot]))[0])
        queue = [(max(0.0, d - self.pages[self.root][1]), self.root, d)]
        while queue:
            low, page, d = heapq.heappop(queue)
            if low > reach:
                break
            _, _, leaf, at, stored, radii = self.pages[page]
            if leaf:
                at = at[np.abs(d - stored) <= reach]
                self.computed += len(at)
                take(at)
                if len(heap) == k:
                    reach = min(reach, known(heap[0][0]))
                continue
            ok = np.abs(d - stored) - radii <= reach
            at, r = at[ok], radii[ok]
            if not len(at):
                continue
            child = to(np.array([self.pages[c][0] for c in at]))
            for c, dc, rc in zip(at.tolist(), child.tolist(), r.tolist()):
                lower = max(0.0, dc - rc)
                if lower <= reach:
                    heapq.heappush(queue, (lower, c, dc))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x, kind): components as doubles; kind, the binary length of the vector's length. Rows that take no part are gone."""
    x = F.transform(vec_col, lambda v: v.cast("double"))
    finite = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(finite)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.length(F.bin(F.size(vec_col))).alias("kind"))


def _matrix(part: list, width: int | None = None) -> np.ndarray:
    """Vectors as rows of whole numbers, zeros after the shorter."""
    width = max(map(len, part), default=0) if width is None else width
    out = np.zeros((len(part), width))
    for i, x in enumerate(part):
        out[i, : len(x)] = x
    return whole(out)


def _trees(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    tree = MTree(part["vec_id"].to_numpy(), _matrix(part["x"].tolist()))
    return pd.DataFrame({"shard": [key[0]], "tree": [pickle.dumps(tree, protocol=5)]})


def _order(score: int) -> str:
    """A string that sorts as the number does, whatever its size."""
    digits = str(abs(score))
    told = f"{len(digits):05d}{digits}"
    return "1" + told if score >= 0 else "0" + told.translate(str.maketrans("0123456789", "9876543210"))


def _searcher(k: int):
    def run(key: tuple, trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for blob in trees["tree"]:
            tree = pickle.loads(blob)
            for q, x, floor in zip(queries["vec_id"].tolist(), queries["x"], queries["floor"]):
                found = tree.search(whole(np.asarray(x, float)), k, leave_out=q, floor=int(floor) if isinstance(floor, str) else None)
                out += [(q, v, max(-(2**63), min(2**63 - 1, s)), _order(s), str(s)) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "place", "exact"]).astype({"query_id": "int64", "vec_id": "int64", "score": "int64"})

    return run


_FOUND = "query_id long, vec_id long, score long, place string, exact string"


def _asked(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Answers to queries (vec_id, x, floor, block, shard), each of one shard; a tree is copied to each block that asks it."""
    wanted = queries.select("shard", "block").distinct()
    left = trees.join(wanted, "shard").toDF("s", "tree", "b")
    return left.groupBy("s", "b").cogroup(queries.groupBy("shard", "block")).applyInPandas(_searcher(k), _FOUND)


class Cells:
    """Pivots per kind of length, lifted by the largest squared norm, and after counting each cell's radius and shards."""

    def __init__(self, samples: dict[int, list], most: float, wanted: dict[int, int]) -> None:
        self.most, self.pivots = most, {}
        self.size: dict[tuple[int, int], tuple[float, int]] = {}
        for kind, vectors in samples.items():
            points = self.lifted([x for x in vectors if max(map(abs, x), default=0.0) * FACTOR < LARGEST], (1 << kind) - 1)
            if not len(points):
                continue
            chosen, near = [0], np.full(len(points), np.inf)
            while len(chosen) < min(wanted[kind], len(points)):
                near = np.minimum(near, np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1)))
                if near.max() <= 0:
                    break
                chosen.append(int(near.argmax()))
            self.pivots[kind] = points[chosen]

    def lifted(self, vectors: list, width: int) -> np.ndarray:
        v = _floats(_matrix([x[:width] for x in vectors], width))
        return np.concatenate([v, np.sqrt(np.maximum(0.0, self.most - (v**2).sum(axis=1)))[:, None]], axis=1)

    def cell_of(self, kind: int, vectors: list) -> tuple[np.ndarray, np.ndarray]:
        """(cell, distance to its pivot) of vectors of one kind."""
        if kind not in self.pivots:
            return np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
        points = self.lifted(vectors, (1 << kind) - 1)
        d = np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.pivots[kind]], axis=1)
        return d.argmin(axis=1), d.min(axis=1)

    def shards(self, x: list, floor: int | None, first: bool) -> list[str]:
        """The shards that a query asks: first, one of its nearest cell; then all that may hold better than floor, but that one."""
        low: list[tuple[float, int, int]] = []
        own = _floats(whole(np.asarray(x, float)))
        huge = bool((np.abs(own) >= LARGEST).any())
        for (kind, cell), (radius, _) in self.size.items():
            if kind not in self.pivots or huge:
                low.append((0.0, kind, cell))
                continue
            p = self.pivots[kind][cell]
            q = np.zeros(len(p))
            n = min(len(own), len(p) - 1)
            q[:n] = own[:n]
            low.append((max(0.0, float(np.sqrt(((q - p) ** 2).sum())) - radius), kind, cell))
        low.sort()
        start = (low[0][1], low[0][2], 0)
        if first:
            return [f"{start[0]}-{start[1]}-0"]
        base = float((own**2).sum()) + self.most
        reach = np.inf if floor is None or huge else np.sqrt(max(0.0, base - 2.0 * float(floor))) * (1 + MARGIN) + MARGIN * np.sqrt(base) + MARGIN
        return [f"{kind}-{cell}-{s}" for d, kind, cell in low if d <= reach for s in range(self.size[kind, cell][1]) if (kind, cell, s) != start]


def _placed(cells: Cells):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cell, d = np.zeros(len(b), np.int64), np.zeros(len(b))
            for kind in b["kind"].unique():
                at = np.flatnonzero(b["kind"].to_numpy() == kind)
                cell[at], d[at] = cells.cell_of(int(kind), [b["x"].iloc[i] for i in at])
            yield b.assign(cell=cell, d=d)

    return run


def _routed(cells: Cells, first: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            to = [cells.shards(x, int(f) if isinstance(f, str) else None, first) for x, f in zip(b["x"], b["floor"])]
            yield b.assign(shard=to)

    return run


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row for which is_query(id) holds, its k best other rows."""
    rows = usable(vectors, id_col, vec_col)
    nth = F.dense_rank().over(W.partitionBy("x").orderBy("vec_id"))
    fresh = rows.dropDuplicates(["vec_id", "x"]).withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth")
    kept = cut(fresh)
    square = lambda v: (F.abs(v) * FACTOR + 1) * (F.abs(v) * FACTOR + 1)
    size = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.when(F.abs(v) <= LARGEST, square(v)).otherwise(F.lit(0.0)))
    told = kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most")).collect()  # a row per binary length
    if not told:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).limit(0)
    wanted = {r["kind"]: min(PIVOTS, -(-r["n"] // shard_rows)) for r in told}
    samples = {kind: [r["x"] for r in kept.where((F.col("kind") == kind)).orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(SAMPLED).collect()] for kind, n in wanted.items() if n > 1 and (1 << kind) <= WIDEST}
    cells = Cells(samples, max(r["most"] for r in told), wanted)
    placed = cut(kept.mapInPandas(_placed(cells), "vec_id long, x array<double>, kind int, cell long, d double"))
    for r in placed.groupBy("kind", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect():  # a row per pivot
        cells.size[r["kind"], r["cell"]] = (r["d"] * (1 + MARGIN) + MARGIN * cells.most**0.5, -(-r["n"] // shard_rows))
    many = F.create_map(*[v for (kind, cell), (_, n) in cells.size.items() for v in (F.lit(f"{kind}-{cell}"), F.lit(n))])
    name = F.concat_ws("-", "kind", "cell")
    shard = F.concat_ws("-", name, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.element_at(many, name)))
    trees = cut(placed.select("vec_id", "x", shard.alias("shard")).groupBy("shard").applyInPandas(_trees, "shard string, tree binary"))

    asked = rows.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min("x").alias("x"))
    blocks = max(1, -(-asked.count() // block_rows))
    asked = cut(asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(blocks)).cast("int")))
    routes = "vec_id long, x array<double>, block int, floor string, shard array<string>"

    def answers(queries: DataFrame, first: bool) -> DataFrame:
        sent = cut(queries.mapInPandas(_routed(cells, first), routes).withColumn("shard", F.explode("shard")))
        return cut(_asked(trees, sent, k))

    best = W.partitionBy("query_id").orderBy(F.desc("place"), "vec_id")
    found = answers(asked.withColumn("floor", F.lit(None).cast("string")), True)
    if sum(n for _, n in cells.size.values()) > 1:
        worst = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("exact").alias("floor"))
        found = found.unionByName(answers(asked.join(worst, "vec_id", "left"), False))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
