"""Bounded-space best fit."""

import random
from collections import defaultdict

import pytest

from tamarisk.llm import packing


def test_best_fit_takes_the_tightest_bin():
    f = packing.BestFit(10, 4)
    assert [f.put(s) for s in (6, 7, 3, 4)] == [0, 1, 1, 0]  # 3 goes to the bin with 3 left, 4 to that with 4
    assert f.open == 0


def test_the_fullest_bin_closes_first():
    f = packing.BestFit(10, 2)
    a, b = f.put(6), f.put(7)
    c = f.put(8)  # closes the bin with 7
    assert (a, b, c) == (0, 1, 2) and f.put(3) == 0 and f.put(2) == 2


@pytest.mark.parametrize("task_units", [10**9, 400])
def test_every_unit_is_packed_once(spark, task_units):
    random.seed(1)
    sizes = {i: random.choice([0, 1, 5, 20, 49, 50, 51, 120, 333]) for i in range(300)}
    df = spark.createDataFrame([(i, "k", s, "x") for i, s in sizes.items()] + [(None, "k", 7, "x"), (1000, "k", None, "x"), (5, "other", 9, "x")], "doc_id bigint, kind string, units bigint, container string")
    plans = spark.createDataFrame([(1, "k", 50), (2, "k", 400), (3, "none", 10), (4, "k", 0)], "plan_id int, kind string, capacity int")
    rows = packing.pack(df, plans, task_units=task_units).collect()
    assert {r.plan_id for r in rows} == {1, 2}
    for plan, cap in ((1, 50), (2, 400)):
        mine = [r for r in rows if r.plan_id == plan]
        used, pieces = defaultdict(int), defaultdict(list)
        for r in mine:
            used[r.container] += r.units
            pieces[r.doc_id].append((r.piece, r.start, r.units))
        assert max(used.values()) <= cap
        for i, s in sizes.items():
            p = sorted(pieces.get(i, []))
            assert sum(u for _, _, u in p) == s and [x for x, _, _ in p] == list(range(1, len(p) + 1)) and all(st == (k * cap) for k, (_, st, _) in enumerate(p))
            assert len(p) == -(-s // cap)
        assert sum(u for _, _, u in pieces[None]) == 7
    if task_units > 10**6:
        a = {(r.plan_id, r.doc_id, r.piece): r.container for r in rows}
        again = packing.pack(df.repartition(7), plans).collect()
        assert {(r.plan_id, r.doc_id, r.piece): r.container for r in again} == a
        fill = {r.plan_id: r.filled for r in packing.fill(packing.pack(df, plans), plans).collect()}
        assert fill[1] > 0.85 and fill[2] > 0.9


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, kind string, units bigint")
    plans = spark.createDataFrame([(1, "k", 50)], "plan_id int, kind string, capacity int")
    assert packing.pack(df, plans).count() == 0 and packing.pack(df, plans.limit(0)).count() == 0
