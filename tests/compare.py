"""Results of a query and of its SQL as sorted rows of text."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"


def text(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def tables(path=DATA):
    con = duckdb.connect()
    for name in os.listdir(path):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path}/{name}'")
    return con


def by_spark(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(map(text, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())


def by_sql(con, sql):
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    at = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(text(r[i]) for i in at) for r in got.fetchall())
