"""Every core query that has SQL gives the rows of that SQL."""

import pytest

from helpers import rows_of
from korvex import queries as core


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got, want = core.QUERIES[name](spark, sf).toPandas(), duck.sql(core.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_every_core_query_has_sql():
    assert set(core.QUERIES) == set(core.SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
