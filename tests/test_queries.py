"""Every query with SQL gives the rows DuckDB gives; the others run."""

import pytest
from conftest import DATA, agrees

from loomseek import core_queries, reference_queries

ALL = {**reference_queries.QUERIES, **core_queries.QUERIES}
SQL = {**reference_queries.ORACLES, **core_queries.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    agrees(spark, duck, ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, name):
    assert ALL[name](spark, DATA).count() >= 0
