"""A query beside its SQL in DuckDB."""

import os

import duckdb


def _plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if value is None or isinstance(value, (int, str, bool)):
        return value
    return str(value)


def connection(sf_dir):
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    return con


def assert_same(df, sql, con):
    relation = con.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    order = [relation.columns.index(c) for c in df.columns]
    want = sorted([tuple(_plain(r[i]) for i in order) for r in relation.fetchall()], key=str)
    got = sorted([tuple(_plain(v) for v in r) for r in df.collect()], key=str)
    assert got == want
