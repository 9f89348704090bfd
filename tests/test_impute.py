"""Filling missing values: masks, edge cases, and accuracy on values that were hidden."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tamarisk.operators import impute
from tamarisk.plans.quality import diabetes_spec
from tamarisk.plans.scale import table

SPEC = impute.FillSpec("id", {"y": (0.0, 100.0)}, "k", ("a", "b"), ("x",), "g", "p", "t", "arrived")
SCHEMA = "id bigint, y string, k string, x double, g int, p bigint, t timestamp, arrived timestamp, y_filled string, extra string"


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, y string, k string, x double, g int, p bigint, day int, late int, y_filled string, extra string").selectExpr("id", "y", "k", "x", "g", "p", "timestamp_seconds(day * 86400) AS t", "timestamp_seconds(late) AS arrived", "y_filled", "extra")


def test_masks_and_edges(spark):
    rows = [
        (1, " 10 ", " a", 1.0, 1, 1, 1, 0, "clash", "e"), (1, " 10 ", " a", 1.0, 1, 1, 1, 9, "clash", "e"), (2, "+12.5", "b", 2.0, 1, 1, 2, 0, None, None), (3, "?", "", None, None, None, None, None, None, None), (4, "101", "c", 1.0, 2, 2, 40, 0, None, None),
        (5, None, None, 1.0, 2, 2, 41, 0, None, None), (None, "7", "a", 1.0, 2, 2, 1, 0, None, None), (None, "", "a", 1.0, 2, 2, 1, 0, None, None), (6, "1e2", "a", 3.0, 1, 1, 3, 0, None, None), (7, "10.", "a", 3.0, 1, 1, 3, 0, None, None),
    ]
    out = impute.fill_missing(frame(spark, rows), SPEC)
    got = {r.id: r for r in out.where("id IS NOT NULL").collect()}
    assert len(got) == 7 and out.count() == 9
    assert got[1].y == 10.0 and not got[1].y_filled and got[1].k == "a" and not got[1].k_filled and got[1].extra == "e"
    assert got[2].y == 12.5
    for i in (3, 4, 5, 6, 7):
        assert got[i].y_filled and 0 <= got[i].y <= 100
    for i in (3, 4, 5):
        assert got[i].k_filled and got[i].k in ("a", "b")
    found = {(r.id, r.field) for r in impute.found(out, SPEC).where("id IS NOT NULL").collect()}
    assert found == {(3, "y"), (4, "y"), (5, "y"), (6, "y"), (7, "y"), (3, "k"), (4, "k"), (5, "k")}


def test_empty_and_hopeless_tables(spark):
    assert impute.fill_missing(frame(spark, []), SPEC).count() == 0
    rows = [(1, "", "", 1.0, 1, 1, 1, 0, None, None), (2, None, None, 1.0, 1, 1, 1, 0, None, None)]
    out = impute.fill_missing(frame(spark, rows), SPEC)
    # Missing values that nothing can fill are marked as neither given nor filled, and still found.
    assert all(r.y is None and r.y_filled is None and r.k is None and r.k_filled is None for r in out.collect())
    assert sorted((r.id, r.field) for r in impute.found(out, SPEC).collect()) == [(1, "k"), (1, "y"), (2, "k"), (2, "y")]


@pytest.fixture(scope="module")
def hidden(spark):
    """sf0.01 with a tenth of the usable values hidden, and the fills."""
    d = "/root/testdata/sf0.01"
    spec = diabetes_spec(spark, d)
    src = impute.first_delivery(table(spark, d, "diabetes"), "record_id", "received_at")
    hide = lambda k: F.pmod(F.xxhash64(F.lit(k), "record_id"), F.lit(10)) == 0
    masked = src.withColumns({c: F.when(hide(i), None).otherwise(F.col(c)) for i, c in enumerate([*spec.numeric, "class"])})
    truth = src.select("record_id", *[impute.usable_number(c, *b).alias(f"t_{c}") for c, b in spec.numeric.items()], impute.usable_category("class", ("0", "1")).alias("t_class"), *[hide(i).alias(f"h_{c}") for i, c in enumerate([*spec.numeric, "class"])])
    return spec, impute.fill_missing(masked, spec).join(truth, "record_id").toPandas()


def test_hidden_numbers_are_predicted(hidden):
    spec, t = hidden
    for c in spec.numeric:
        h = t[t[f"h_{c}"] & t[f"t_{c}"].notna()]
        rmse = ((h[c] - h[f"t_{c}"]) ** 2).mean() ** 0.5
        assert len(h) > 100 and rmse < 0.75 * t[f"t_{c}"].std(), c


def test_hidden_classes_are_predicted(hidden):
    _, t = hidden
    h = t[t["h_class"] & t["t_class"].notna()]
    assert (h["class"] == h["t_class"]).mean() > 0.9


def test_no_null_is_left(hidden):
    spec, t = hidden
    assert not t[[*spec.numeric, "class"]].isna().any().any()


def test_spec_is_frozen():
    with pytest.raises(dataclasses.FrozenInstanceError):
        SPEC.key = "x"
