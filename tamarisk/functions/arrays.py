"""List and set functions on arrays, Column to Column. A null array gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def union(a: Col, b: Col) -> Column:
    """Distinct items of both, in order."""
    return F.array_union(_c(a), _c(b))


def union_keeping(a: Col, b: Col) -> Column:
    """All of ``a``, repeated items too, then the items of ``b`` that are not in it."""
    return F.concat(_c(a), F.filter(_c(b), lambda x: ~F.array_contains(_c(a), x)))


def intersection(a: Col, b: Col) -> Column:
    return F.array_intersect(_c(a), _c(b))


def relative_intersection(a: Col, b: Col) -> Column:
    """Common items over the length of the longer list; 0 if both are empty."""
    most = F.greatest(F.size(_c(a)), F.size(_c(b)))
    return F.when(most == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / F.greatest(most, F.lit(1)))


def difference_keeping(a: Col, b: Col) -> Column:
    """Items of ``a`` that are not in ``b``, repeated ones kept, in order."""
    return F.filter(_c(a), lambda x: ~F.array_contains(_c(b), x))


def difference(a: Col, b: Col) -> Column:
    return F.array_except(_c(a), _c(b))


def remove_first(a: Col, b: Col, ignore_case: bool = False) -> Column:
    """``a`` without the first occurrence of each item of ``b``; an item twice in ``b`` takes two."""
    same = F.lower if ignore_case else (lambda v: v)

    def drop(acc: Column, item: Column) -> Column:
        at = F.array_position(F.transform(acc, same), same(item)).cast("int")
        return F.when(at > 0, F.concat(F.slice(acc, F.lit(1), F.greatest(at - 1, F.lit(0))), F.slice(acc, F.greatest(at, F.lit(0)) + 1, F.size(acc)))).otherwise(acc)

    return F.aggregate(_c(b), _c(a), drop)


def append_new(a: Col, item: Col) -> Column:
    return F.when(F.array_contains(_c(a), _c(item)), _c(a)).otherwise(F.array_append(_c(a), _c(item)))


def unique(a: Col, ignore_case: bool = False, prune_empty: bool = False, key: Callable[[Column], Column] | None = None) -> Column:
    """Distinct items in order of first occurrence; ``ignore_case``: the first spelling stays; ``key``: items are the same if it is."""
    c = F.filter(_c(a), lambda x: x != "") if prune_empty else _c(a)
    key = key or (F.lower if ignore_case else None)
    if key is None:
        return F.array_distinct(c)
    keys = F.transform(c, key)
    return F.filter(c, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def exactly_one(a: Col, zero_ok: bool = False) -> Column:
    """True iff one item of an array of booleans is true; ``zero_ok``: or none."""
    n = F.size(F.filter(_c(a), lambda x: x))
    return (n == 1) | ((n == 0) if zero_ok else F.lit(False))


def is_subset(a: Col, b: Col) -> Column:
    return F.size(F.array_except(_c(a), _c(b))) == 0


def equivalent(a: Col, b: Col) -> Column:
    return is_subset(a, b) & is_subset(b, a)


def xor(*xs: Col) -> Column:
    """True iff exactly one is true."""
    return exactly_one(F.array(*[_c(x) for x in xs]))


def unzip(a: Col, fields: int) -> list[Column]:
    """The k-th items of an array of arrays, one array for each k."""
    def part(k: int) -> Column:
        return F.transform(_c(a), lambda x: F.try_element_at(x, F.lit(k + 1)))

    return [part(k) for k in range(fields)]


def overlap(a: Col, b: Col) -> Column:
    """The longest run of tokens that ends one array and starts the other (``a`` before ``b`` first); empty if there is none."""

    def one(x: Column, y: Column) -> Column:
        most = F.least(F.size(x), F.size(y))
        fits = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: (k <= most) & (F.slice(x, F.size(x) - k + 1, k) == F.slice(y, F.lit(1), k)))
        k = F.coalesce(F.array_max(fits), F.lit(0))
        return F.slice(y, F.lit(1), k)

    first = one(_c(a), _c(b))
    return F.when(F.size(first) > 0, first).otherwise(one(_c(b), _c(a)))


def title_case_ngram(tokens: Col, stop: list[str]) -> Column:
    """True iff the first and last token are in title case and the inner ones in title case or stop words."""
    t = _c(tokens)
    title = lambda x: x.rlike(r"^\p{Lu}[^\p{Lu}]*$")
    inner = F.slice(t, F.lit(2), F.greatest(F.size(t) - 2, F.lit(0)))
    return title(t[0]) & title(F.element_at(t, -1)) & F.forall(inner, lambda x: title(x) | F.lower(x).isin(*stop))


def windows(a: Col, n: int) -> Column:
    """All runs of ``n`` neighbouring items."""
    c = _c(a)
    return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1))), lambda i: F.slice(c, i, n))).otherwise(F.slice(F.array(c), 2, 1))
