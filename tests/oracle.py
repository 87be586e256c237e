"""Compares a query with its SQL in DuckDB."""

import decimal
import os

import duckdb


def connection(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{folder}/{name}')")
    return con


def plain(x):
    if x is None or isinstance(x, (str, bool)):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x) + 0.0:.6f}".replace("-0.000000", "0.000000")
    return str(x)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(con, frame, sql):
    theirs = con.sql(sql)
    assert sorted(frame.columns) == sorted(theirs.columns)
    mine, other = normal(frame.collect(), frame.columns), normal(theirs.fetchall(), theirs.columns)
    assert len(mine) == len(other)
    assert mine == other
    assert mine, "an empty result proves nothing"
