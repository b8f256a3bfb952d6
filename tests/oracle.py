"""DuckDB over the test tables, and comparison of results as sets of rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def run_sql(sql: str, folder: str = DATA) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    got = con.execute(sql)
    return [x[0] for x in got.description], got.fetchall()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return x


def table(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same_kind(df, columns: list[str], rows: list[tuple]) -> None:
    assert sorted(df.columns) == sorted(columns)
    a, b = table(df.columns, df.collect()), table(columns, rows)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y
