"""The registered queries on values and texts: as DuckDB says where there is SQL, and whole tables everywhere."""

import pytest

from logmill.llm.queries import QUERIES, SQL
from tests.conftest import SF
from tests.test_queries import con, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):  # noqa: F811
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got)
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_counts_lie_in_their_intervals(spark):
    got = QUERIES["p4_counts"](spark, SF).toPandas()
    assert ((got["low"] <= got["n"]) & (got["n"] <= got["high"])).all()
