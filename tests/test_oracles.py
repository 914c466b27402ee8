"""Every query of the catalogue against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quaystone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(name, spark, data, con):
    ours = catalogue.QUERIES[name](spark, data)
    cursor = con.execute(catalogue.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(ours.columns) == sorted(columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).count() > 0
