"""Runs a query and its SQL on the same tables and compares all rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SMALL = "/root/testdata/sf0.001"


def plain(frame):
    columns = sorted(frame.columns)
    rows = frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()
    return columns, sorted((tuple(r) for r in rows), key=repr)


def assert_same(df, sql, sf_dir=SMALL):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    mine, theirs = plain(df.toPandas()), plain(con.execute(sql).fetchdf())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
