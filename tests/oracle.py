"""Holds a query's rows against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if not os.path.exists(path):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def same(spark, query, sql, sf_dir: str = DATA) -> int:
    df = query(spark, sf_dir)
    names, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    result = connect(sf_dir).execute(sql)
    want_names, want = ordered([d[0] for d in result.description], result.fetchall())
    assert names == want_names
    assert len(rows) == len(want)
    wrong = [(a, b) for a, b in zip(rows, want) if a != b]
    assert not wrong, (len(wrong), wrong[:3])
    return len(rows)
