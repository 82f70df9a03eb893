"""Shards from a keyed permutation of row numbers.

Rows get dense numbers 0..n-1 in the plain order of their content. A Feistel network over the
smallest near-square grid a x b >= n, with cycle walking, permutes the numbers; position p of the
permutation is slot p div s of shard p mod s. The law is `rows`: shard counts differ by one at most.
The shuffle is reproducible from the seed, and the permutation can be inverted, so that any
(shard, slot) leads back to a row number. The round function is plain integer arithmetic (a square
modulo a prime below 2 ** 31), so that any engine can compute a place.

Defined results: a null text has no bytes (size 16, CRC 0); repeated rows get numbers of their own
and are interchangeable; null ids come first; an empty table gives an empty table.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered_rows

ROUNDS = 6
#: The prime of the round function, and the steps of a walk that are folded at once.
PRIME, WALK = 2147483647, 64


def grid(n: int) -> tuple[int, int]:
    """(a, b) with n <= a * b < n + a, about square."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[tuple[int, int, int]]:
    """(factor, term, term after squaring) of each round, below PRIME."""
    rng, out = seed, []
    for _ in range(ROUNDS):
        key = []
        for _ in range(3):
            rng = (rng * 48271 + 11) % PRIME
            key.append(rng + 1 if rng + 1 < PRIME else 1)
        out.append((key[0], key[1], key[2]))
    return out


def _once(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network: the halves in turn gain a mixture of the other, modulo their own size."""
    state = F.struct((x % a).cast("long").alias("l"), F.call_function("div", x, F.lit(a)).cast("long").alias("r"))
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"k{i}") for i, v in enumerate(k)], F.lit(j % 2 == 0).alias("left")) for j, k in enumerate(round_keys(seed))])

    def step(s: Column, k: Column) -> Column:
        t = (F.when(k["left"], s["r"]).otherwise(s["l"]) * k["k0"] + k["k1"]) % F.lit(PRIME)
        mixed = (t * t + k["k2"]) % F.lit(PRIME)
        left = F.when(k["left"], (s["l"] + mixed) % F.lit(a)).otherwise(s["l"])
        right = F.when(k["left"], s["r"]).otherwise((s["r"] + mixed) % F.lit(b))
        return F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    return F.aggregate(keys, state, step, lambda s: s["l"] + s["r"] * F.lit(a))


def permuted(x: Column, n: int, seed: int = 17) -> Column:
    """The place of row number x (0 <= x < n) in a pseudo-random permutation of 0..n-1.

    A walk from inside meets each number of the grid beyond n at most once, so as many steps as there
    are such numbers always end it. They are folded WALK at a time, and only for rows that need them.
    """
    a, b = grid(n)
    first = _once(x, a, b, seed)
    beyond = a * b - n
    if not beyond:
        return first
    inner = lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), p, lambda q, _: F.when(q < n, q).otherwise(_once(q, a, b, seed)))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(-(-beyond // WALK))), first, lambda p, _: F.when(p < n, p).otherwise(inner(p)))
    return F.when(first < n, first).otherwise(walk)


def feistel_shards(rows: DataFrame, n_shards: int, order: list[str], seed: int = 17) -> DataFrame:
    """rows with row_number, shard (0..n_shards-1) and slot (gapless from 0), by the law `rows`.

    order: columns that fix the row numbers, nulls first; rows equal in all of them are interchangeable.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    numbered = numbered_rows(rows, [F.col(c) for c in order], "row_number")
    n = numbered.count()
    if not n:
        return numbered.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    place = numbered.withColumn("_place", permuted(F.col("row_number"), n, seed))
    return place.withColumns({"shard": (F.col("_place") % n_shards).cast("int"), "slot": F.call_function("div", F.col("_place"), F.lit(n_shards)).cast("long")}).drop("_place")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size (UTF-8 bytes + 16), text_crc32, law, shard, slot, grown_shard, row_number.

    Only these narrow columns are shuffled; the texts stay where they are.
    """
    utf8 = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    narrow = docs.select("doc_id", (F.length(utf8) + 16).cast("long").alias("size"), F.crc32(utf8).alias("text_crc32"))
    out = feistel_shards(narrow, n_shards, ["doc_id", "text_crc32", "size"], seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
