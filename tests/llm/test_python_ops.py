"""Packing, language identification, exact search and page text against plain Python, round trips and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracewright.llm import html_text, langid, mtree, packing, queries
from tracewright.llm.tokens import encoder

DIR, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \nb", "a\n b", "a\n\n b \n c", "\n", "a\r\nb c\td", "it's we'll 'S", "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", "x <|endoftext|>z a",
    "é ñ ü 中文 字 😀 a b   c  d", "\x1c a\x1db \x1e", "don't 12 345 6,7", "a" * 5000, "word " * 3000, "​ x ﻿ y", "tab\t tab \ttab",
]


def reference(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("which", ["odd", "table"])
def test_ids(spark, which):
    texts = ODD if which == "odd" else [r.text for r in queries.table(spark, DIR, "documents").collect()]
    got = [np.frombuffer(b, "<u2").tolist() for b in encoder().encode(texts)]
    assert got == reference(texts)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(ODD)] + [(4, "a", "x", 1), (4, "a", "y", 2), (None, "no id", "z", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, offset int")


@pytest.mark.parametrize("which", ["odd", "table"])
def test_packing(spark, docs, which):
    df = docs if which == "odd" else queries.table(spark, DIR, "documents")
    got = packing.pack_documents(df).collect()
    want, rows = Counter(), df.collect()
    for r, ids in zip(rows, reference([r.text for r in rows])):
        ids = [*ids, 2]
        for k, (start, n) in enumerate(packing.cuts(len(ids))):
            assert n == 1024 or k == 0
            want[(r.doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    bound = -(-sum(r.length for r in got) // 1024)
    if which == "table":
        assert len(seqs) <= bound * 1.05 + 2
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_packing_keeps_ids(spark):
    df = spark.createDataFrame([(1, "some text " * 900)], "doc_id long, text string")
    got = sorted(packing.pack_documents(df, with_ids=True).collect(), key=lambda r: r.piece)
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in got]).tolist()
    assert ids == [*reference(["some text " * 900])[0], 2] and [r.start for r in got] == [0, *np.cumsum([r.length for r in got])[:-1].tolist()]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece(seed):
    rng = np.random.default_rng(seed)
    size = 64
    lengths = rng.integers(1, size + 1, 3000) if seed else np.minimum(size, rng.geometric(0.05, 20_000))
    counts = np.bincount(lengths, minlength=size + 1)
    used = np.zeros_like(counts)
    plan = packing.plan(counts, size)
    for pattern, n in plan:
        assert sum(pattern) <= size and n > 0
        for v in pattern:
            used[v] += n
    assert (used == counts).all()
    bound = max(-(-int(lengths.sum()) // size), int((lengths > size // 2).sum()))
    assert sum(n for _, n in plan) <= 1.03 * bound + 2


def test_plan_empty():
    assert packing.plan(np.zeros(1025, np.int64)) == []


def test_langid_held_out(spark):
    df = queries.table(spark, MID, "documents")
    got = langid.identify(df).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in df.collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.98


def test_langid_odd(spark):
    text = "the cat and the dog were in the house with other animals"
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "123 \n ..", "de", 1), (4, text, "en", 1), (4, text, "en", 1), (None, text, None, 1), (5, text * 2000, "en", 1), (7, "der hund und die katze waren im haus mit anderen tieren", "de", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en" and got[None].held_out
    assert langid.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df.where("lang is null")).collect()} == {"und"}
    assert langid.stage(spark, df, DIR).columns == df.columns
    assert sorted(r.doc_id or 0 for r in langid.stage(spark, df, DIR).collect()) == [0, 4, 4, 5, 7]


def brute_top(rows, queries_, k=10):
    x = {}
    fine = [(i, np.floor(1024 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows]
    m = np.stack([v for _, v in fine])
    ids = np.array([i for i, _ in fine])
    for q, v in queries_:
        s = m @ np.floor(1024 * np.array(v, dtype=float)).astype(np.int64)
        ok = ids != q
        order = np.lexsort((ids[ok], -s[ok]))[:k]
        x[q] = [(int(ids[ok][i]), int(s[ok][i])) for i in order]
    return x


def test_top_k(spark):
    df = queries.table(spark, DIR, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for r in mtree.top_k(df, lambda i: i % 100 == 0, shard_rows=150, block_rows=2).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = brute_top(rows, [r for r in rows if r[0] % 100 == 0])
    assert {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()} == want
    assert all([n for n, _, _ in sorted(v)] == list(range(1, 11)) for v in got.values())


def exact_top(rows, k=10):
    """By Python integers, the shorter vector going on in zeros; equal rows count once."""
    whole = [(i, [int(np.floor(c * 1024)) if abs(c) < 1e300 else int(c) * 1024 for c in v]) for i, v in {(i, tuple(v)) for i, v in rows}]
    out = {}
    for q, x in sorted(((i, v) for i, v in whole if i % 100 == 0), reverse=True):
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in whole if i != q)
        out[q] = [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in scored[:k]]
    return out


def answers(df, **kw):
    got = {}
    for r in mtree.top_k(df, lambda i: i % 100 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in got.items()}


def test_top_k_odd(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), 1) for i in range(900)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5], 1) for i in range(900, 1500)]
    other = [(2400, [], 1), (2500, [1.0], 1), (2501, [0.25] * 9, 1), (2501, [0.25] * 9, 1)]
    bad = [(2000, None, 1), (2100, [None, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] * 4, 1), (2300, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows + other + bad, "vec_id long, embedding array<double>, score int")
    assert answers(df, shard_rows=100) == exact_top([(i, v) for i, v, _ in rows + other])
    few = spark.createDataFrame(rows[:3], df.schema)
    assert mtree.top_k(few, lambda i: i % 100 == 0).count() == 2
    assert mtree.top_k(df.limit(0), lambda i: i % 100 == 0).count() == 0


def test_top_k_large_components(spark):
    rng = np.random.default_rng(5)
    for scale in (1e6, 1e12, 1e200):
        rows = [(i, (np.floor(rng.normal(0, 3, 5)) * scale * rng.choice([1, 1, 1e-6])).tolist()) for i in range(300)]
        rows += [(300 + i, rows[i][1]) for i in range(20)] + [(400, [1.7e308, -1.7e308, 0.0, 1.0, 0.0])]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        assert answers(df, shard_rows=60) == exact_top(rows), scale


def test_search_skips_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 500, (20, 8))
    x = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 20, (4000, 8))).astype(np.int32)
    tree = mtree.MTree(np.arange(4000), x)
    tree.search(x[5], 10)
    assert tree.computed < 2500


def test_blocks():
    page = """<html><head><title>T</title><style>p{}</style></head><body><!-- <p>no</p> --><script>var a="</p><p>x";</script>
    <p>one <b>two</b><br>three &amp; &lt;four&gt; &eacute;&nbsp;x<p>five<ul><li>six<li><a href="a>b">seven</a></ul><table><tr><td>8<td>9</table>tail &am"""
    got = html_text.blocks_of(page)
    assert [b.text for b in got] == ["one two three & <four> é x", "five", "six", "seven", "8", "9", "tail &am"]
    assert got[3].link_chars == 5 and "T:ul" not in got[6].path
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("<p><script>x") == []


def test_labeller_gradient():
    model = html_text.Labeller(3)
    data = [(html_text.features(b), y) for b, y in html_text.sample(6, 5) if b]
    x, mask = html_text._padded([d[0] for d in data])
    y = np.zeros(mask.shape, np.float32)
    for j, d in enumerate(data):
        y[: len(d[1]), j] = d[1]
    _, grad = model.gradients(x, mask, y)
    for name, at in (("xf", (PATH := html_text.PATH + 50, 3)), ("hb", (2, 7)), ("bf", (5,)), ("o", (3, 0))):
        old = model.w[name][at]
        loss = []
        for eps in (1e-2, -1e-2):
            model.w[name][at] = old + eps
            loss.append(model.gradients(x, mask, y)[0])
        model.w[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[name][at]) < 2e-3


def test_written_pages_held_out():
    wrong = total = 0
    model = html_text.trained()
    for blocks, y in html_text.sample(200, 77):
        if blocks:
            wrong += int(((model.verdicts([html_text.features(blocks)])[0] > 0) != (y > 0.5)).sum())
            total += len(y)
    assert wrong / total < 0.005


STORY = "The first paragraph of the story tells what happened in town today, and why."
LAYOUTS = {
    "comments": "<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><h1>M title</h1><p>M {s}</p><section class='comments'><h2>Comments</h2><div class=comment><p>Nice post, I agree.</p></div></section></article></main><footer><p>&copy; 2024</p></footer>",
    "sidebar": "<div id='header'><h1>Site</h1></div><div id='menu'><ul><li><a href=1>One</a></li></ul></div><div id='content'><h1>M Title</h1><p>M {s}</p></div><div id='sidebar'><h3>Recent posts</h3><p>About this site.</p></div><div id='footer'>Copyright</div>",
    "cookie": "<div class='cookie-notice'><p>We use cookies.</p><button>Accept</button></div><article><h1>M T</h1><p>M {s}</p><div class='ad'>Cheap shoes!</div><p>M {s}</p></article><aside><h4>Related</h4></aside><form><label>Email</label><button>Subscribe</button></form><footer>f</footer>",
    "one block": "<header><p>Welcome to our web site about towns</p></header><article><p>M {s}</p></article>",
    "post": "<div class='post'><h2>M Title</h2><p>M {s}</p><ul><li>M item one</li></ul><blockquote>M quoted words</blockquote></div><div id='comments'><h3>3 comments</h3><ul><li><p>Great! I liked the part where things happened.</p></li></ul></div>",
    "table": "<article><h1>M T</h1><table><tr><th>M Name</th><td>M Value</td></tr></table><pre>M code here</pre><div class=advertisement><p>Advert text.</p></div></article>",
    "after": "<nav><ul><li><a href='/a'>a</a></li></ul></nav><div class='ad'>En laleen.</div><article><h1>M H</h1><p>M {s}<br><p>M Ti.</p></article><div class='comments'><p>Une comment ici.</p></div><aside>Side text.</aside><div class='notice'>Notice text.</div><footer>&copy; x</footer>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    page = "<html><body>" + LAYOUTS[name].replace("{s}", STORY)
    got = html_text.main_text(page, html_text.trained())
    assert got == "\n\n".join(b.text for b in html_text.blocks_of(page) if b.text.startswith("M "))


def test_pages(spark):
    df = queries.table(spark, DIR, "pages")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    for r in df.collect():
        want = [b.text for b in html_text.blocks_of(r.html) if "T:article" in b.path]
        assert got[r.page_id].text == "\n\n".join(want) and got[r.page_id].n_chars == len(got[r.page_id].text)
    rows = [(1, None, None, "x"), (1, None, "", "y"), (None, "u", "<p>", "z"), (5, "u", "<article>" + "<p>word one two.</p>" * 3000 + "</article>", "z")]
    odd = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(odd) == 4 and [r.text for r in odd[:3]] == ["", "", ""] and odd[3].text.count("word") > 2900
    assert html_text.extract(df.limit(0)).count() == 0
