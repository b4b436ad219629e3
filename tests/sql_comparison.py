"""Registered queries beside their SQL, run by DuckDB over the same tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def shown(value):
    """A value as text, the same for both engines; doubles to nine digits."""
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int | float | decimal.Decimal):
        return "nan" if math.isnan(value) else f"{float(value):.9g}"
    if isinstance(value, datetime.datetime | datetime.date):
        return value.isoformat()
    if hasattr(value, "asDict"):
        return shown(value.asDict())
    if isinstance(value, dict):
        return str(sorted((str(k), shown(v)) for k, v in value.items()))
    return str([shown(v) for v in value]) if isinstance(value, list | tuple) else str(value)


def of_spark(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())


def of_duckdb(sql):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(shown(row[k]) for k in order) for row in found.fetchall())
