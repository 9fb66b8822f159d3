"""The operators' queries give DuckDB's rows, where SQL can express them."""

import duckdb
import pytest

from taxloom.llm.queries import QUERIES, SQL


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", list(SQL))
def test_query(name, spark, sf):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    wanted = duck.execute(SQL[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(df.columns)
    found = sorted(repr([plain(r[c]) for c in sorted(columns)]) for r in df.collect())
    at = [columns.index(c) for c in sorted(columns)]
    assert found == sorted(repr([plain(r[i]) for i in at]) for r in wanted.fetchall())
