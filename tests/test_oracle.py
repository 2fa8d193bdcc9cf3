"""Every registered query that has an oracle matches DuckDB (driver-style compare)."""

import pytest

from __spark_entry__ import oracle_sql, queries

from .oracle_check import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_matches_duckdb(spark, name):
    res = compare(spark, SF, [name], verbose=False)
    assert res[name] == "OK", res[name]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["month", "Region", "mean_sale"]
    assert df.count() > 0
