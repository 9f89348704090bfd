"""Controlled rounding, exact quotas, reports."""

from collections import Counter
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from tamarisk.llm import sampling


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=7), min_size=1, max_size=6), st.integers(1, 40))
def test_rounding_keeps_both_margins(counts, share):
    width = max(map(len, counts))
    table = {}
    for r, row in enumerate(counts):
        n = sum(row)
        take = min(n, n * share // 40)
        for c, v in enumerate(row + [0] * (width - len(row))):
            if n:
                table[str(r), c] = Fraction(take * v, n)
    whole = sampling.round_table(table)
    for k, v in table.items():
        assert v - 1 < whole[k] < v + 1
    for margin in (0, 1):
        exact, got = Counter(), Counter()
        for k, v in table.items():
            exact[k[margin]] += v
            got[k[margin]] += whole[k]
        for k, v in exact.items():
            assert got[k] == v if margin == 0 else v - 1 < got[k] < v + 1


TARGETS = "plan_id int, table_name string, sample_pct int, class string, target_pct int, min_rows int"


def data(spark, n=3000):
    # One class has two thirds of all rows, one stratum a third of them.
    rows = [(i, "Big " if i % 3 else "small" if i % 6 else ["SMALL", None, "", "other"][i // 6 % 4], 1 if i % 3 == 0 else i % 50) for i in range(n)]
    df = spark.createDataFrame(rows + rows[:200], "id bigint, label string, g int")
    return sampling.records(df, "t", "id", "label", "g")


def test_quotas_are_exact_and_repeat(spark):
    recs = data(spark)
    targets = spark.createDataFrame([(1, "t", 50, "big", 60, 5), (1, "t", 50, "small", 40, 5), (2, "t", 10, "big", 0, 7), (2, "t", 90, "small", 100, 1), (3, "t", 10, "absent", 100, 2), (4, "empty", 50, "x", 100, 3)], TARGETS)
    drawn = sampling.draw(recs, targets).collect()
    per = Counter((r.plan_id, r.class_key) for r in drawn)
    have = Counter(r.class_key for r in recs.collect())
    total = have["big"] + have["small"]
    assert per[1, "big"] == total * 50 * 60 // 10000 and per[1, "small"] == total * 50 * 40 // 10000
    assert per[2, "big"] == 7 and per[2, "small"] == min(have["small"], total * 90 * 100 // 10000)
    assert len({(r.plan_id, r.key) for r in drawn}) == len(drawn) and not any(r.class_key in ("", "other", None) for r in drawn)
    again = sampling.draw(recs.repartition(5), targets).collect()
    assert {(r.plan_id, r.key) for r in again} == {(r.plan_id, r.key) for r in drawn}
    rep = {(r.plan_id, r["class"]): r for r in sampling.report(recs, targets).collect()}
    assert rep[3, "absent"].drawn == 0 and not rep[3, "absent"].met and not rep[4, "x"].met and rep[1, "big"].met
    assert rep[2, "small"].drawn == have["small"] and not rep[2, "small"].met


def test_strata_keep_their_shares(spark):
    recs = data(spark)
    targets = spark.createDataFrame([(1, "t", 40, "big", 100, 1)], TARGETS)
    have = Counter(r.stratum for r in recs.where("class_key = 'big'").collect())
    keys = {r.key for r in sampling.draw(recs, targets).collect()}
    got = Counter(r.stratum for r in recs.where("class_key = 'big'").collect() if r.key in keys)
    total, n = sum(have.values()), len(keys)
    for s, v in have.items():
        assert abs(got[s] - v * n / total) < 1


def test_empty_tables(spark):
    recs = data(spark, 10).limit(0)
    targets = spark.createDataFrame([(1, "t", 40, "big", 100, 1)], TARGETS)
    assert sampling.draw(recs, targets).count() == 0 and sampling.draw(data(spark, 10), targets.limit(0)).count() == 0
