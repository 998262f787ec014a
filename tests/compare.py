"""Spark and DuckDB results as sorted lists of plain rows."""

import glob
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    return float(value) if isinstance(value, float) else value


def rows_of_spark(df):
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)
