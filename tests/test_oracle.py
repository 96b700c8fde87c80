"""Every registered analysis against its SQL on the small tables."""

import decimal

import duckdb
import pytest

from loam.operators import registry

DIR = "/root/testdata/sf0.001"
TABLES = "documents pages events conversations labels".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, DIR)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert a == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_answer_has_rows(spark):
    row = registry.queries()["r1_r5_retrieval"](spark, DIR).first()
    assert row.snippets > 0 and row.files.count(";") == 7 and row.text.startswith("RETRIEVAL") and row.full_tokens > row.retrieved_tokens
