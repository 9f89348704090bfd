"""Suffix-sorted counting against counting by hand."""

import random
import re
import unicodedata
from collections import Counter

import pytest

from tamarisk.llm import ngrams


def by_hand(texts, most):
    cf, df = Counter(), Counter()
    for t in texts:
        words, w = [], ""
        for c in (t or "").lower():
            if unicodedata.category(c)[0] in "LMN":
                w += c
            elif w:
                words.append(w)
                w = ""
        words += [w] if w else []
        grams = [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    return {g: (len(g.split(" ")), cf[g], df[g]) for g in cf}


TEXTS = [None, "", " ... ", "The cat. The cat sat", "the THE the", "Été é 12½ ②x", "naïve नमस्ते", "ΣΑΣ İx", "a" * 5000, "one two one two one"] + ["of the hot word the hot word"] * 40


@pytest.mark.parametrize("most", [1, 2, 4])
def test_counts(spark, most):
    random.seed(most)
    texts = TEXTS + [" ".join(random.choices("a b c d e".split(), k=random.randint(0, 9))) for _ in range(60)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, suffix int").repartition(5)
    got = {r.ngram: (r.n, r.occurrences, r.records) for r in ngrams.count_ngrams(df, max_n=most).collect()}
    assert got == by_hand(texts, most)


def test_small_batches_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "COMBINE", 3)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    got = {r.ngram: (r.n, r.occurrences, r.records) for r in ngrams.count_ngrams(df, max_n=3).collect()}
    assert got == by_hand(TEXTS, 3)


def test_records_and_marks(spark):
    rows = [(1, "a b", 1), (1, "a b", 2), (2, None, 1), (3, "a", 1), (4, "a c", 1), (None, "c", 1), (None, "c", 2)]
    df = spark.createDataFrame(rows, "id bigint, text string, seen int")
    one = ngrams.one_record(df, "id", "text", "seen")
    n = ngrams.record_count(df, "id", "text", "seen")
    assert one.count() == 6 and n == 5
    m = {r.ngram: r.mark for r in ngrams.mark_terms(ngrams.count_ngrams(one), n, 2, 50).collect()}
    assert m == {"a": "common", "b": "rare", "c": "common"}


def test_empty(spark):
    assert ngrams.count_ngrams(spark.createDataFrame([], "text string")).count() == 0


def test_term_pattern_has_no_blank():
    assert not re.search(r"\s", "".join(by_hand(["a b"], 1)))
