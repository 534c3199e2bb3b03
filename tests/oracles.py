"""Rows of a query and of its SQL, in a form that compares."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connection(folder):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for f in folder.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def both(spark, query, sql, folder):
    """(rows of the query, rows of the SQL), columns by name, in order."""
    df = query(spark, str(folder))
    cols = sorted(df.columns)
    cur = connection(folder).execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    return sorted((tuple(map(norm, r)) for r in df.select(*cols).collect()), key=repr), want
