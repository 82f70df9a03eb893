"""SentencePiece encoding against the library, and the DataFrame lattice against the same."""

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tests.llm.test_python_ops import ODD
from tracewright.llm import queries, spm

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(spm.MODEL))


@pytest.mark.parametrize("which", ["odd", "table"])
def test_documents(spark, library, which):
    texts = [*ODD, "▁ a▁b ▁", "<s> </s> <0x0A> <unk>", "x" * 30_000] if which == "odd" else [r.text for r in queries.table(spark, DIR, "documents").collect()]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "a b", 2), (90_000, "a", 3), (90_000, "a", 3)]
    got = spm.encode_documents(spark.createDataFrame(rows, "doc_id long, text string, ids int"), with_ids=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    for i, t in enumerate(texts):
        assert np.frombuffer(by[i].ids, "<u4").tolist() == library.encode(t or "") and by[i].n_ids == len(by[i].ids) // 4
    assert spm.encode_documents(spark.createDataFrame(rows[:0], "doc_id long, text string, ids int")).count() == 0


def test_words(spark, library):
    words = ["▁the", "▁antidisestablishment", "▁▁▁x", "▁é", "▁中文字", "▁", "▁a\nb", "▁😀", "▁heller", "▁aaaaaaa", "▁12345"]
    got = spm.encode_words(spark.createDataFrame([(w,) for w in words + words[:2]], "word string")).collect()
    assert sorted(r.word for r in got) == sorted(words)
    table = spm.pieces()
    for r in got:
        parts = [r.word[a:b] for a, b in zip(r.cuts, r.cuts[1:])]
        ids = []
        for p, i in zip(parts, r.ids):
            ids += [i] if i is not None else [table.byte_ids[b] for b in p.encode()]
        assert ids == library.encode(r.word[1:].replace(spm.MARK, " ")) or not r.word[1:]
        assert ids == table.word_ids(r.word)


def test_viterbi(spark):
    scores = {"a": -1.0, "b": -1.5, "ab": -2.0, "aba": -2.2, "ba": -1.9, "c": -4.0}
    table = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(scores.items())], "piece string, id int, score double")
    words = ["a", "ab", "abab", "ababa", "cab", "axb", "x"]
    got = {r.word: [r.word[a:b] for a, b in zip(r.cuts, r.cuts[1:])] for r in spm.encode_words(spark.createDataFrame([(w,) for w in words], "word string"), "unigram", table, 3).collect()}

    def best(w):
        if not w:
            return 0.0
        return max(scores.get(w[:k], -100.0 if k == 1 else -math.inf) + best(w[k:]) for k in range(1, min(3, len(w)) + 1))

    for w in words:
        assert "".join(got[w]) == w
        assert math.isclose(sum(scores.get(p, -100.0) for p in got[w]), best(w))


def test_places_are_packed_and_numbered(spark, monkeypatch):
    """Blocks have numbers of their own over all tasks; what leaves for the lattice is one number a unit."""
    for n in (0, 1, 1000):
        places = np.arange(n, dtype="<u4") * 70_000
        assert spm._unpacked(spm._packed(places)).tolist() == places.tolist()
    assert len(spm._packed(np.arange(5000, dtype="<u4") * 37 % 5000)) < 5000 * 2
    monkeypatch.setattr(spm, "cut", lambda df, **_: df)
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(40)], "doc_id long, text string").repartition(4)
    rows = docs.mapInArrow(spm._blocks, spm._BLOCK).collect()
    assert len({r.block for r in rows}) == len(rows) == 4 and dict(docs.mapInArrow(spm._blocks, spm._BLOCK).dtypes)["block"] == "bigint"
    words = spark.createDataFrame([(5 << spm.PLACE_BITS, "▁the"), (7, "▁the"), (9, "qz")], "place long, word string")
    got = {r.place: r.ids for r in spm.encode_units(words, spm.piece_table(spark), spm.pieces().longest).collect()}
    told = {p: [int.from_bytes(x[i : i + 2], "big") for i in range(0, len(x), 2)] for p, x in got.items()}
    assert told == {p: spm.pieces().word_ids(w) for p, w in ((5 << spm.PLACE_BITS, "▁the"), (7, "▁the"), (9, "qz"))}


def test_ids_come_back_packed(monkeypatch):
    """Ids of units, given in any order and in batches, come back by block in the order of places, in 8 bytes a unit at most."""
    rng = np.random.default_rng(5)
    places = [(block << spm.PLACE_BITS) + at for block in (3, 7 << spm.BLOCK_BITS) for at in range(0, 20_000, 5)]
    ids = {p: rng.integers(0, 32_000, rng.integers(1, 4)).astype(">u2") for p in places}
    order = rng.permutation(places)
    batches = [pa.RecordBatch.from_arrays([pa.array(part), pa.array([ids[p].tobytes() for p in part.tolist()], pa.binary())], ["place", "ids"]) for part in np.array_split(order, 7)]
    for most, rows in ((1_000_000, 2), (4000, 4)):
        monkeypatch.setattr(spm, "GATHERED", most)
        got = [r for b in spm._gathered(iter([batches[0][:0], *batches])) for r in b.to_pylist()]
        assert len(got) == rows and sum(len(r["told"]) for r in got) < 8 * len(places)
        back = {}
        for r in got:
            at, n, flat = spm._told(r["told"])
            assert (np.diff(at) > 0).all()
            back |= {(r["block"] << spm.PLACE_BITS) + a: x.tolist() for a, x in zip(at.tolist(), np.split(flat, np.cumsum(n)[:-1]))}
        assert back == {p: x.tolist() for p, x in ids.items()}
