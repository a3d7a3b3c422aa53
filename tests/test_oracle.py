"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tidefold import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple("" if pd.isna(v) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(Q.SQL))
def test_query(spark, duck, name) -> None:
    got, expected = Q.QUERIES[name](spark, DATA).toPandas(), duck.sql(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


def test_every_query_has_sql() -> None:
    assert set(Q.QUERIES) == set(Q.SQL)


def test_entry(spark) -> None:
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
