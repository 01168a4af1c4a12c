"""Comparison of a query's rows with those of its DuckDB text."""

import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return round(float(value), 9) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows(names: list[str], data) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


def assert_same(spark, sf_dir: str, query, sql: str) -> None:
    found = query(spark, sf_dir)
    wanted = connect(sf_dir).sql(sql)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(wanted.columns, wanted.fetchall())
