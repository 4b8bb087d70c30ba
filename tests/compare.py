"""Spark rows against SQL rows, in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(data: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return ""
    if isinstance(v, float):
        return f"{v + 0:.6g}"
    return str(v)


def rows(found) -> list[tuple]:
    return sorted(tuple(map(plain, r)) for r in found)


def same(df, con, sql: str) -> None:
    result = con.sql(sql)
    names = sorted(df.columns)
    assert sorted(result.columns) == names
    order = [result.columns.index(n) for n in names]
    assert rows(df.select(*(f"`{n}`" for n in names)).collect()) == rows([[r[i] for i in order] for r in result.fetchall()])
