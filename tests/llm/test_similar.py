"""The near-copy stage of the pipeline against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tracewright.llm import queries, simhash

DIR = "/root/testdata/sf0.001"


def jaccard_classes(rows):
    """rows: (id, text). Smallest id reachable over pairs of Jaccard similarity 0.8 or more, by comparing all pairs."""
    sets = {}
    for i, text in rows:
        words = brute.WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if (x == y or (x and y and 5 * len(x & y) >= 4 * len(x | y))) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def edited():
    """Texts with growing edits of a few bases, around the threshold, and texts that share a long passage only."""
    rng, rows = random.Random(9), [(0, None), (1, " "), (2, "one two"), (3, "One  two")]
    shared = [f"s{k}" for k in range(60)]
    for base in range(6):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.choice([30, 64, 150]))]
        for n in range(25):
            own = list(words)
            for _ in range(n % 5):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            rows.append((len(rows) + 10, " ".join(own)))
    for n in range(50):
        rows.append((len(rows) + 10, " ".join([*shared, *(f"o{n}w{k}" for k in range(n % 20))])))
    return rows


@pytest.mark.parametrize("which", ["edited", "table"])
def test_similar_texts(spark, which):
    rows = edited() if which == "edited" else [(r.doc_id, r.text) for r in queries.table(spark, DIR, "documents").collect()]
    want = jaccard_classes(rows)
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_stage_drops_near_copies(spark):
    words = [f"w{k}" for k in range(64)]
    rows = [(2, " ".join(words)), (56, " ".join([*words[:-1], "other"])), (60, " ".join(words[:32]))]
    out = simhash.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), DIR).collect()
    assert sorted(r.doc_id for r in out) == [2, 60]


def test_a_crowd_first_offers_the_nearest_of_unlike_class():
    """Of a crowd of one shingle, two members of unlike class for each at most; at the end all pairs of unlike class."""
    n = 40
    numbers = {"shard": np.zeros(n), "t": np.zeros(n), "key": np.arange(n), "fp": np.arange(n), "n": np.full(n, 50), "pos": np.zeros(n), "class": np.arange(n) % 20, "side": np.zeros(n)}
    batch = pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in numbers.values()], list(numbers))
    pairs = {near: [(r["a"], r["b"]) for b in simhash._more_candidates(iter([batch]), nearest=near) for r in b.to_pylist()] for near in (True, False)}
    assert len(set(pairs[False])) == len(pairs[False]) == n * (n - 1) // 2 - 20
    assert n // 2 <= len(pairs[True]) <= simhash.NEAREST * n and set(pairs[True]) < set(pairs[False])


def test_the_order_knows_common_shingles_of_a_larger_table(spark, monkeypatch):
    """Shingles of 40 documents each are known in a table of twenty times the least sample, so that they make no crowded shard."""
    monkeypatch.setattr(simhash, "SAMPLED", 100)
    rows = [(k, f"f{k % 50} a b c d " + " ".join(f"o{k}w{j}" for j in range(20))) for k in range(2000)]
    known, counts = simhash.common_shingles(spark.createDataFrame(rows, "doc_id long, text string"))
    want = {int(simhash.shingles(f"f{k} a b c d", 5)[0]) for k in range(50)}
    assert len(want & set(known.tolist())) >= 45 and counts.min() > 2
