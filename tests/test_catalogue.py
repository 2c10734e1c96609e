"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from plumage.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9) + 0.0
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return float(value) if hasattr(value, "as_tuple") else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, FOLDER)
    relation = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=key)
    assert [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in ours] == [tuple(float(v) if isinstance(v, int) and not isinstance(v, bool) else v for v in r) for r in theirs]


def test_registry_matches():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
