"""Every query with SQL against DuckDB on the smallest tables; the others run and have rows."""

import math
import os

import duckdb
import pytest

from millrace.plans import catalogue, reporting

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(columns, rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r)), columns


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = rows_of(columns, [tuple(r[c] for c in columns) for r in df.collect()])
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == rows_of(columns, [tuple(r[i] for i in at) for r in cursor.fetchall()])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_every_bag_has_one_test_score_of_each_pooler(spark, sf):
    got = catalogue.QUERIES["train_probe"](spark, sf).select("pooling", "bag_id", "class").collect()
    bags = [r["bag_id"] for r in catalogue._vector_bags(spark, sf).select("bag_id").collect()]
    want = [(p, b, c) for p in ("mean", "lme") for b in bags for c in (0, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
