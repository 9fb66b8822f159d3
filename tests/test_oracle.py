"""Every registered query that SQL can express gives DuckDB's rows."""

import datetime
import decimal
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if not re.match(r"op\d|pipeline", n)]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, decimal.Decimal | float):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query(name, spark, duck, sf):
    df = entry.queries()[name](spark, sf)
    got = df.collect()
    wanted = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, wanted.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1500
    assert "clave_acceso" in df.columns


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
