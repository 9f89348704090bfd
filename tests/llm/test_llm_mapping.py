"""Token repair and ranking of entries."""

import random

import pytest

from tamarisk.llm import mapping

REF = [(1, "Zousira Nifea", "Zousira", "ZSR"), (2, "Zousira Castipos", "Zousira", "ZSR"), (3, "Zousira Castipos Eco", "Zousira", "ZSR"), (4, "Körgoze Hustain 480", "Körgoze", "KRG"), (5, "Körgoze Hustain", "Körgoze", "KRG"), (6, "Beakol Dromi", "Beakol", "BKL"), (7, "Ampere Volta", "Ampere", None), (8, "Bexmix Volta", "Bexmix", None)]
CASES = {
    "zousira nifea": 1, "NIFEA": 1, "zsr. nifea": 1, "Nifea, Zousira": 1, "Zousira/Castipos": 2, "Zousira Castipos ECO (used)": 3, "2012 castipos eco": 3, "Korgoze Hustain 480": 4, "KörgozeHustain480": 4, "korgoze_hustain": 5, "Zous1ra N1fea": 1, "Zoisura Nifea": 1, "Bеakol Dromi": 6, "beakol droi": 6, "beakoldromi": 6,
    "Zousira": -1, "Zousira Hikizim": -1, "Nozimnoth 340": -1, "asdf": -1, "??": -1, "Beakol Nifea": -1, "Volta": -1, "Bexmix Volta diesel": 8, "\tZousira  Nifea.": 1,
}


@pytest.fixture(scope="module")
def mapped(spark):
    v = spark.createDataFrame([(x,) for x in [*CASES, *CASES, None, "", " \t"]], "typed string")
    ref = spark.createDataFrame([*REF, (9, None, None, None)], "id bigint, name string, maker string, abbr string")
    return {r.value: r.id for r in mapping.map_values(v, ref).collect()}


@pytest.mark.parametrize("typed", CASES)
def test_value(mapped, typed):
    assert mapped[typed] == CASES[typed]


def test_blank_values_are_left_out_and_repeats_once(mapped):
    assert len(mapped) == len(CASES)


def test_empty_tables(spark):
    v = spark.createDataFrame([("a",)], "typed string")
    ref = spark.createDataFrame([], "id bigint, name string, maker string, abbr string")
    assert mapping.map_values(v, ref).first().id == -1 and mapping.map_values(v.limit(0), ref).count() == 0


def test_signatures_find_every_near_word():
    random.seed(2)
    for n in range(1500):
        w = "".join(random.choices("abcd", k=random.randint(3, 9) if n < 500 else random.randint(22, 60)))
        t = list(w)
        for _ in range(mapping.max_edits(len(w))):
            i = random.randrange(len(t)) if t else 0
            kind = random.choice("dist")
            if kind == "d" and t:
                t.pop(i)
            elif kind == "t" and len(t) > 1:
                i = min(i, len(t) - 2)
                t[i], t[i + 1] = t[i + 1], t[i]
            elif kind == "i":
                t.insert(i, random.choice("abcd"))
            elif t:
                t[i] = random.choice("abcd")
        t = "".join(t)
        if len(t) >= 3 and mapping.distance(t, w, 2) <= mapping.max_edits(len(w)) and mapping.max_edits(len(t)) >= mapping.max_edits(len(w)):
            assert mapping.signatures(t, False) & mapping.signatures(w, True), (t, w)


def test_distance():
    assert mapping.distance("abcd", "acbd", 2) == 1 and mapping.distance("abc", "abc", 0) == 0 and mapping.distance("abc", "xyz", 1) == 2


def test_long_words_have_few_signatures():
    assert max(len(mapping.signatures("ab" * n, v)) for n in (10, 13, 200, 2000) for v in (True, False)) < 400


def test_a_word_of_every_entry_and_endless_tokens(spark):
    """Every entry holds the same maker and extra word; a third of the values is one text; two values hold an endless string."""
    ref = spark.createDataFrame([(i, f"zorvex model{i:03d} deluxe".replace("model", "qu" + "abcdefghij"[i % 10] * 2 + "ip"), "zorvex", "zx") for i in range(300)], "id bigint, name string, maker string, abbr string")
    values = [f"zx qu{'abcdefghij'[i % 10] * 2}ip{i:03d} deluxe" for i in range(60)]
    v = spark.createDataFrame([(x,) for x in values] + [(values[0],)] * 30 + [("zorvex " + "x" * 50_000,), ("y" * 50_000 + " deluxe",)], "typed string")
    got = {r.value: r for r in mapping.map_values(v, ref).collect()}
    assert len(got) == 62 and all(r.id == -1 for x, r in got.items() if len(x) > 1000)
    assert mapping.map_values(v, ref, need_head=False, maker_agrees=False).count() == 62
