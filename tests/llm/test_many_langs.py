"""Language identification over more languages than the sample was once bounded to."""

import math
import random

from tests.llm import brute
from tracewright.llm import langid, queries


def test_every_language_is_learned(spark):
    rng, rows = random.Random(4), []
    for k in range(45):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)]
        for _ in range(14 if k else 8):
            rows.append((len(rows), " ".join(rng.choice(words) for _ in range(60)), f"l{k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert {i for i, _, v in rows if v == "l0" and got[i] != v} == set()
    assert set(got.values()) == {f"l{k}" for k in range(45)}


def test_letters():
    assert [langid.has_letter(t) for t in (None, "", "½ ² ① 10", "12 a", "字", "_")] == [False, False, False, True, True, False]


def test_predictions_against_plain_loops(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    model = langid.learn(docs)
    odd = [None, "", "½ ² ① 10", "a", "Der Hund", "日本語", "x" * 3000]
    texts = odd + [r.text for r in docs.where("doc_id % 4 = 0").collect()]
    got = model.predict(texts)
    want = [brute.language(t, model, langid.family_of) for t in texts]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-6, abs_tol=1e-9) for g, w in zip(got, want))


def test_a_repeated_row_does_not_flood_the_sample(spark):
    from pyspark.sql import functions as F

    docs = queries.table(spark, "/root/testdata/sf0.001", "documents").where("lang is not null").select("doc_id", "text", "lang")
    hot = docs.where("doc_id = 1").crossJoin(spark.range(3000)).drop("id")  # one row by 3000
    found = langid.identify(docs.unionByName(hot)).groupBy("doc_id").agg(F.count_distinct("lang_pred").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert found.where("n > 1").count() == 0 and found.agg(F.max("rows")).first()[0] == 3001
