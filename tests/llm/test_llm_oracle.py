"""The llm queries against their SQL, and the others for running at all."""

import pytest
from conftest import SF, same_rows

from tamarisk.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = same_rows(catalog.QUERIES[name](spark, SF), duck, catalog.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
