"""Every catalog key with oracle SQL matches DuckDB on the same tables
(row count, column names, order-insensitive values) at sf0.001."""

import pytest

import __spark_entry__ as E
from .oracle_compare import compare, duck

from .conftest import SF001

KEYS = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, con, key):
    info = compare(spark, con, key, E.queries()[key], E.oracle_sql()[key], SF001)
    assert info["cols"] and info["rows"] and info["values"] and info["types"], info


def test_every_sql_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["sku_id", "warehouse_id", "date", "step", "forecast_kg", "lower_bound",
                          "upper_bound", "optimal_order", "type"]
    assert df.count() > 0
