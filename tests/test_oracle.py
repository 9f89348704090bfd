"""Every query of the core against its SQL, and without a cross join in its plan."""

import pytest
from conftest import SF, same_rows

from tamarisk.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got, want = same_rows(df, duck, catalog.SQL[name])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["tfidf_top_bigrams", "tfidf_pruned_terms", "query_hits", "spelling_not_listed", "lookup_with_default", "p4_found", "embedding_l2_neighbours", "nearest_colour"])
def test_no_cross_join(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["embedding_l2_neighbours"](spark, SF)._jdf.queryExecution().toString()
    assert "label" not in plan.split("Physical Plan")[-1]
    plan = catalog.QUERIES["confusion_matrix"](spark, SF)._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert "insulin" not in plan and "ReadSchema" in plan
