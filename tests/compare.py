"""Runs a query and its SQL on the same tables and compares them as bags of rows."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def difference(spark, con, f, sql: str, sf_dir: str) -> str:
    df = f(spark, sf_dir)
    got = bag(df.columns, df.collect())
    rel = con.sql(sql)
    want = bag(rel.columns, rel.fetchall())
    if got == want:
        return ""
    if got[0] != want[0]:
        return f"columns {got[0]} against {want[0]}"
    a, b = set(got[1]), set(want[1])
    return f"rows {len(got[1])} against {len(want[1])}; only Spark {list(a - b)[:2]}; only SQL {list(b - a)[:2]}"
