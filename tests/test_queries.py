"""Every registered query with SQL gives what DuckDB gives; every other one runs."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from logmill.queries import problems, reference
from tests.conftest import SF

CORE = {**reference.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(None if v is None or isinstance(v, float) and math.isnan(v) else v for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, con, name):
    got = CORE[name](spark, SF).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["timestamp", "total", "debug", "info", "warn", "error", "fatal"] and df.count() == 30
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
