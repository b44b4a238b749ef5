"""A query's rows against its SQL on the same tables."""

import datetime
import math
from pathlib import Path

import duckdb


def connection(data):
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


def check(spark, data, name, query, sql):
    df = query(spark, data)
    relation = connection(data).sql(sql)
    assert sorted(df.columns) == sorted(relation.columns), name
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(relation.columns, relation.fetchall()), name
