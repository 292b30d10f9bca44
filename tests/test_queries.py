"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import pytest
from conftest import SF, same_rows

from tidewright import queries as library


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_against_sql(spark, duck, name):
    same_rows(library.QUERIES[name](spark, SF), duck.sql(library.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs(spark, name):
    rows = library.QUERIES[name](spark, SF).collect()
    # Production grids trade seldom on the smallest table.
    assert name in ("strategy_ou_long_only", "wfo_garch") or name.endswith("_grid") or rows
