"""Every query over tables against its SQL."""

import math

import duckdb
import pytest

from tracewright.plans import code_tables, tables

QUERIES, SQL = tables.QUERIES | code_tables.QUERIES, tables.SQL | code_tables.SQL
DIR = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    found = con.execute(SQL[name])
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_evaluation_reads_the_sources_of_its_ground_truth_once(spark):
    """They are parsed before, not again by every use of the queries and the places."""
    plan = code_tables.evaluation(spark, DIR)._jdf.queryExecution().toString()
    assert "p_brand" not in plan
