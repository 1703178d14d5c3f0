"""Runs a registered query and its DuckDB oracle on the same tables and compares all values."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def _value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in records), key=repr)


def oracle(sql, sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = con.sql(sql)
    return rows(found.columns, found.fetchall())


def query(spark, f, sf=SF):
    df = f(spark, sf)
    return rows(df.columns, [tuple(r) for r in df.collect()])
