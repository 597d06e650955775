"""Compares a query with its SQL, as the driver does: columns by name, rows in any order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    if isinstance(x, float) and math.isnan(x):
        return "None"
    if isinstance(x, float):
        return f"{x:.6g}" if x else "0"
    if isinstance(x, datetime.datetime) and x.time() == datetime.time():
        x = x.date()
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in data)


def oracle(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def of(df):
    return rows(df.columns, df.collect())
