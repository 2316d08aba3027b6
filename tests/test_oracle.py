"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None else repr(round(float(v), 6)) if isinstance(v, float) and not math.isnan(v) else repr(bool(v)) if isinstance(v, bool) else repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    want, got = rows_of(names, cursor.fetchall()), rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert got == want


def test_entry(spark):
    assert os.path.isdir(SF) and entry.entry(spark).count() > 0
