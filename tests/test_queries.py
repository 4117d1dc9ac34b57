"""Every query that has SQL gives the rows DuckDB gives on the same tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(df: pd.DataFrame) -> list:
    def value(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return tuple(value(y) for y in x)
        if x is None or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, pd.Timestamp):
            return x.tz_localize(None) if x.tzinfo else x
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return bool(x)
        if isinstance(x, str):
            return x
        try:
            f = float(x)
        except (TypeError, ValueError):
            return x
        return None if math.isnan(f) else round(f, 6)

    return sorted((tuple(value(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def duck(tiny):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, duck, tiny):
    ours, theirs = QUERIES[name](spark, tiny).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, tiny):
    assert entry.entry(spark).count() > 0
