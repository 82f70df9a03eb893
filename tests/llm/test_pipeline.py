"""The pipeline against a plain Python version, stage by stage."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_python_ops import reference
from tests.llm.test_similar import jaccard_classes
from tracewright.llm import langid, quality, queries

DIR = "/root/testdata/sf0.001"


def good(text):
    n, chars, symbols, dup, _, failed = brute.quality(text)
    words = brute.WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    stop = sum(w.lower() in quality.STOP_WORDS for w in words)
    letters = sum(any(c.isalpha() for c in w) for w in words)
    bullets = sum(bool(re.match(r"\s*[-*•]", x)) for x in lines)
    dots = sum(bool(re.search(r"(\.\.\.|…)\s*$", x)) for x in lines)
    return not failed and 2 <= chars / n <= 20 and symbols / n <= 0.1 and stop / n >= 0.01 and letters / n >= 0.7 and dup / len(lines) <= 0.5 and bullets / len(lines) <= 0.9 and dots / len(lines) <= 0.4


def masked(docs):
    """docs: (id, text, source). Texts with base spans and owner-specific wide tokens replaced."""
    owners, repos, spans = defaultdict(set), defaultdict(set), {}
    for i, text, source in docs:
        base = [tuple(map(int, s.split(":")[1:])) for s in brute.secrets(text)[4].split(",") if s]
        wide = []
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
            if not any(a < m.end() and m.start() < b for a, b in base) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                wide.append((m.start(), m.end(), m[0]))
                owners[m[0]].add(source)
                repos[m[0]].add(i)
        for name, pattern, group, least in brute.KINDS:
            for m in pattern.finditer(text):
                if len(m.group(group)) >= least:
                    owners[m.group(group)].add(source)
                    repos[m.group(group)].add(i)
        spans[i] = base, wide
    out = []
    for i, text, _ in docs:
        base, wide = spans[i]
        every = sorted(base + [(a, b) for a, b, v in wide if len(owners[v]) <= 1 and len(repos[v]) <= 3])
        told, at = "", 0
        for k, (a, b) in enumerate(every):
            if a > at or (k == 0 and a == 0):
                told += text[at:a] + "[SECRET]"
            at = max(at, b)
        out.append((i, told + text[at:]))
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "simhash_dedup", "secret_scan", "best_fit_packing"]


def test_against_brute_force(spark):
    docs = queries.table(spark, DIR, "documents")
    rows = [(r.doc_id, r.text, r.source, r.lang) for r in docs.collect()]
    rows = [r for r in rows if good(r[1])]
    model = langid.learn(quality.stage(spark, docs, DIR))
    found = [model.predict([r[1]])[0] for r in rows]
    rows = [r for r, f in zip(rows, found) if f[0] != "und" and f[2] >= 0.5]
    classes = jaccard_classes([r[:2] for r in rows])  # five words, 0.8 or more
    rows = [r for r in rows if classes[r[0]] == r[0]]
    texts = masked([r[:3] for r in rows])
    want = Counter()
    for (i, _), ids in zip(texts, reference([t for _, t in texts])):
        ids = [*ids, 2]
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start : start + 1024] if k else ids[:first]
            want[(i, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = corpus_pipeline.run(spark, DIR).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for s in places.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024


def test_stages_keep_columns(spark):
    docs = queries.table(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_empty(spark):
    empty = queries.table(spark, DIR, "documents").limit(0)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, DIR).count() == 0


def awkward(spark):
    """Documents with null texts, null and repeated ids, and columns named as the stages' own."""
    from pyspark.sql import functions as F

    docs = queries.table(spark, DIR, "documents").where("doc_id % 7 = 0").select("doc_id", "text", "lang", "source", "n_chars")
    odd = docs.limit(1)
    odd = odd.withColumn("doc_id", F.lit(None).cast("long")).unionByName(odd.withColumn("text", F.lit(None).cast("string"))).unionByName(odd)
    out = docs.unionByName(odd)
    for name in ("_text", "_words", "_lines", "_hashes", "_shift", "_packed", "_again", "_spans", "_d", "_k", "_key", "_nth", "row", "id", "t", "nth", "key", "spans"):
        out = out.withColumn(name, F.concat(F.lit(name), "doc_id"))
    return out.withColumn("n_words", F.lit(7)).withColumn("kept", F.lit("mine"))


def test_stages_leave_other_columns_alone(spark):
    docs = awkward(spark)
    texts = dict(corpus_pipeline.STAGES)["secret_scan"](spark, docs, DIR).select("doc_id", "text").collect()
    assert Counter(r.doc_id for r in texts) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before = Counter(tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars")) for r in docs.collect())
        after = Counter(tuple(v for k, v in r.asDict().items() if k not in ("text", "n_chars")) for r in out.collect())
        assert after and not after - before, name
        if name == "simhash_dedup":
            assert all(n == 1 for r, n in after.items() if r[0] is not None) and sum(n for r, n in after.items() if r[0] is None) == 1


def test_run_over_awkward_tables(spark, tmp_path):
    docs = awkward(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {(r.offset, r.length) for r in rows if r.offset + r.length > 1024} == set()
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
