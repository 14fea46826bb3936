"""The registered queries: against DuckDB where there is SQL, otherwise that each row is there."""

import math
import os

import duckdb
import pytest

from millrace.llm import queries

ROWS = {"op1_simhash": "documents", "op5_toxicity": "documents", "op6_language_id": "pages", "op8_packing": "documents", "op10_quality": "documents", "op11_alignment": "documents"}


def plain(v):
    return (None if math.isnan(v) else round(v, 7)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        assert os.path.exists(f"{sf}/{t}.parquet")
        duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    at = [c[0] for c in cursor.description]
    assert sorted(at) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted((tuple(plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall()), key=key)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key) == want


@pytest.mark.parametrize("name", sorted(ROWS))
def test_a_row_for_each_row(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() == spark.read.parquet(f"{sf}/{ROWS[name]}.parquet").count()


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
