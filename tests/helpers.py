"""Comparison of a query's rows with DuckDB's."""

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def assert_matches(spark, query, sql, sf_dir=SF):
    got = query(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    assert sorted(got.columns) == sorted(rel.columns)
    names = sorted(got.columns)
    a = Counter(tuple(norm(r[c]) for c in names) for r in got.collect())
    at = [rel.columns.index(c) for c in names]
    b = Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
    assert a == b, (list((a - b).items())[:3], list((b - a).items())[:3])
