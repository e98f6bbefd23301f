"""Each registered query against DuckDB, on whole tables at the smallest scale."""

import pytest

import __spark_entry__ as entry
from freshet.bindings.registry import QUERIES
from tests.compare import difference, spark_rows
from tests.conftest import SF

EVERY_SQL = entry.oracle_sql()
RUNS = {name: run for name, run in entry.queries().items() if name in QUERIES}
EXPECTED = {name: EVERY_SQL[name] for name in RUNS if name in EVERY_SQL}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_matches_duckdb(spark, con, name):
    dtypes, rows = spark_rows(spark, RUNS[name], SF)
    assert difference(dtypes, rows, con, EXPECTED[name]) is None


def test_every_query_has_sql():
    assert set(RUNS) == set(EXPECTED)


def test_entry_has_stable_columns(spark):
    table = entry.entry(spark)
    assert table.columns[:2] == ["station_name", "drainage_area_km2"]
    assert table.count() > 0
