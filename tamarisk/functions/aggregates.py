"""User-defined aggregates and table functions: aggregates as compositions of built-in ones, which Spark combines before it shuffles,
and a table function over single values."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F


def geometric_mean(x: Column) -> Column:
    """Of the positive values; null without any."""
    return F.exp(F.avg(F.when(x > 0, F.log(x))))


def harmonic_mean(x: Column) -> Column:
    """Of the values that are not zero; null without any."""
    return F.count(F.when(x != 0, x)) / F.sum(F.when(x != 0, 1 / x))


@F.udtf(returnType="word string, start int")
class word_spans:  # noqa: N801
    """(word, start) of the words of a text that blanks part, starts counted from 0; a null text has none."""

    def eval(self, text: str) -> Iterator[tuple[str, int]]:
        at = 0
        for word in (text or "").split(" "):
            if word:
                yield word, at
            at += len(word) + 1
