"""Runs a query in Spark and its SQL in DuckDB, and compares rows by column name."""

import datetime
import decimal
import glob

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({glob.glob(path + '/*.parquet') or [path]!r})")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def check(spark, sf_dir, query, sql, connection):
    df = query(spark, sf_dir)
    got, names = df.collect(), df.columns
    result = connection.execute(sql)
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(want_names)
    assert rows_of(names, got) == rows_of(want_names, want)
