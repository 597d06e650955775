"""Compares a query with its SQL, as the driver does: columns by name, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf, **frames):
    con = duckdb.connect()
    for t in TABLES:
        if t in frames:
            con.register(t, frames[t])
        elif os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return rows(names, got.fetchall())


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(str(r[i]) for i in order) for r in data)


def of(df):
    return rows(df.columns, df.collect())
