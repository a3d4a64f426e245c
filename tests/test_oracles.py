"""Every query that has SQL gives DuckDB's rows, names and types on the smallest tables."""

import math

import duckdb
import pytest

from __spark_entry__ import PLANS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "int": "INTEGER"}
QUERIES = {n: (f, m.ORACLES.get(n)) for m in PLANS for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def value(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_oracle(spark, duck, name):
    query, sql = QUERIES[name]
    df = query(spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    answer = duck.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert {d[0]: str(d[1]) for d in answer.description} == {c: TYPES[t] for c, t in df.dtypes}
    want = sorted((tuple(value(r[names.index(c)]) for c in columns) for r in answer.fetchall()), key=repr)
    assert got == want
