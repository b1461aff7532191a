"""Compares a query with its SQL in DuckDB, order aside."""

import decimal

import duckdb

from folia.plans.fixtures import TABLES


def norm(v):
    return f"{float(v):.9g}" if isinstance(v, (float, decimal.Decimal)) else str(v)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def assert_same(df, sql, sf_dir):
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(x) for x in r) for r in df.select(columns).collect())
    result = duck(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = sorted(tuple(norm(r[k]) for k in order) for r in result.fetchall())
    assert mine == theirs
