"""Every registered query against its SQL on the smallest tables."""

import datetime

import duckdb
import pytest

from vestige.jobs.catalogue import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    return v.isoformat() if isinstance(v, datetime.date) else v


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([cell(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert as_rows(df.columns, df.collect()) == as_rows(want.columns, want.fetchall())
