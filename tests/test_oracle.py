"""Every query with SQL gives the SQL's rows on the smallest tables."""

import math

import duckdb
import pytest

from lodestone.catalog import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return ("", "")
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return (type(x).__name__, str(x))
    return ("number", f"{round(float(x), 5) + 0.0:.5f}")


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in table)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    found = QUERIES[name](spark, data)
    if name not in SQL:
        assert found.count() > 0
        return
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(names, want.fetchall())
