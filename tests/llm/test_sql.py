"""Queries against their DuckDB SQL, over a small table; and the permutation against plain Python."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import chat, queries, sharding

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [x[0] for x in found.description]
    want = sorted(found.fetchall(), key=repr)
    df = queries.QUERIES[name](spark, DIR)
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want


def place(x, n, keys):
    a, b = sharding.grid(n)
    left, right = x % a, x // a
    while True:
        for k, (ka, kb, kc) in enumerate(keys):
            if k % 2 == 0:
                left = (left + (((right * ka + kb) % 2147483647) ** 2 + kc) % 2147483647) % a
            else:
                right = (right + (((left * ka + kb) % 2147483647) ** 2 + kc) % 2147483647) % b
        if left + right * a < n:
            return left + right * a


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 5000])
def test_places(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n).alias("p")).collect()}
    keys = sharding.round_keys(17)
    assert got == {x: place(x, n, keys) for x in range(n)} and sorted(got.values()) == list(range(n))


def test_many_equal_rows(spark):
    docs = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = sharding.shard_documents(docs, 7).collect()
    assert sorted(r.row_number for r in rows) == list(range(3000))
    assert sorted((r.shard, r.slot) for r in rows) == sorted((p % 7, p // 7) for p in range(3000))


def test_null_conversations(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (None, 2, "user", None), (3, 0, "user", "c")]
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {None, 3} and got[None].n_turns == 3 and got[None].loss_chars == 1
