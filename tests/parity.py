"""Spark rows against DuckDB rows, order and last bits aside."""

import datetime
import glob
import math
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return [found.columns[k] for k in order], sorted(tuple(plain(r[k]) for k in order) for r in found.fetchall())
