"""Rows of a query and of its SQL in one comparable form."""

import math

import duckdb

from assetgraph.fixtures import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else int(v) if v == int(v) else round(v, 9)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(_value(r[k]) for k in order)) for r in rows)


def spark_rows(df):
    return sorted(df.columns), _rows(df.columns, df.collect())


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), _rows(names, cur.fetchall())
