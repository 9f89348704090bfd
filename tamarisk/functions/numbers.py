"""Number functions, Column to Column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | str


def _c(x: Num) -> Column:
    return F.col(x) if isinstance(x, str) else x


def round_as_text(x: Num, places: int = 6) -> Column:
    """Rounded to ``places`` and padded with zeros."""
    return F.format_string(f"%.{places}f", _c(x).cast("double"))


def to_float(x: Num, default: float = 0.0) -> Column:
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def to_int(x: Num, default: int = 0, base: int = 10) -> Column:
    """The whole number in a text, cut towards zero; ``default`` if there is none."""
    if base != 10:
        digits = "0-9" if base > 9 else f"0-{base - 1}"
        pattern = rf"^[+-]?[{digits}{'a-' + chr(86 + base) if base > 10 else ''}]+$"
        return F.when(F.lower(_c(x)).rlike(pattern), F.conv(_c(x), base, 10).try_cast("bigint")).otherwise(F.lit(default).cast("bigint"))
    return F.coalesce(_c(x).try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def to_bool(x: Num) -> Column:
    """False for false, none, off, 0 and the empty text in any case, and for null; else true."""
    return ~F.lower(F.coalesce(_c(x).cast("string"), F.lit(""))).isin("false", "none", "off", "0", "")


def is_close(a: Num, b: Num, eps: float = 1e-6) -> Column:
    """Equal within ``eps`` or within a relative 1e-9."""
    return F.abs(_c(a) - _c(b)) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(_c(a)), F.abs(_c(b))), F.lit(eps))


def whole_as_int(x: Num) -> Column:
    """The number as text, without decimals if it is whole."""
    return F.when(_c(x) == F.floor(_c(x)), _c(x).cast("bigint").cast("string")).otherwise(_c(x).cast("string"))


def is_prime(x: Num) -> Column:
    """True iff a whole number has no divisor but 1 and itself; tries 2, 3 and the numbers beside multiples of 6 up to its square root."""
    n = _c(x).cast("bigint")
    top = F.greatest(F.floor(F.sqrt(F.greatest(n, F.lit(4)).cast("double"))).cast("bigint"), F.lit(5).cast("bigint"))
    beside = F.forall(F.sequence(F.lit(5).cast("bigint"), top, F.lit(6).cast("bigint")), lambda d: (n % d != 0) & (n % (d + 2) != 0))
    return (n > 1) & ((n < 4) | ((n % 2 != 0) & (n % 3 != 0) & ((n < 25) | beside)))


#: Primes that are tried on all numbers of a batch at once; what is left has only larger factors.
TRIED = [p for p in range(2, 1 << 12) if all(p % q for q in range(2, int(p**0.5) + 1))]


def _surely_prime(n: int) -> bool:
    """The strong test to the first twelve primes, which is exact below 2^64; ``n`` is odd and has no factor in TRIED."""
    twos = ((n - 1) & (1 - n)).bit_length() - 1
    for base in TRIED[:12]:
        x = pow(base, (n - 1) >> twos, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def _large_factors(n: int) -> list[int]:
    """The prime factors, in order, of a number that has none in TRIED, by Pollard's rho method."""
    if n < TRIED[-1] ** 2 or _surely_prime(n):
        return [n]
    for c in range(1, n):
        x = y = 2
        while True:
            # The differences of many steps share one common divisor; where it is n, they are gone through one by one.
            at, product = (x, y), 1
            for _ in range(128):
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                product = product * (x - y) % n
            if (f := math.gcd(product, n)) > 1:
                break
        if f == n:
            (x, y), f = at, 1
            while f == 1:
                x = (x * x + c) % n
                y = (y * y + c) % n
                y = (y * y + c) % n
                f = math.gcd(x - y, n)
        if f < n:
            return sorted(_large_factors(f) + _large_factors(n // f))
    raise ArithmeticError(n)  # never: some c parts every number that is not prime


def _factors_of(n: np.ndarray) -> list[np.ndarray]:
    """The prime factors of each number in order: small primes divide all numbers at once, the rest one by one."""
    rest = np.maximum(n, 1)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def note(at: np.ndarray, values) -> None:
        rows.append(at)
        found.append(np.broadcast_to(np.asarray(values, np.int64), at.shape))

    live = np.arange(len(rest))
    for p in TRIED:
        live = live[rest[live] >= p * p]
        if not len(live):
            break
        hit = live[rest[live] % p == 0]
        while len(hit):
            rest[hit] //= p
            note(hit, p)
            hit = hit[rest[hit] % p == 0]
    large = rest > TRIED[-1] ** 2
    one = np.flatnonzero((rest > 1) & ~large)
    note(one, rest[one])
    for value in np.unique(rest[large]):
        for f in _large_factors(int(value)):
            note(np.flatnonzero(rest == value), f)
    at = np.concatenate(rows)
    return np.split(np.concatenate(found)[np.argsort(at, kind="stable")], np.cumsum(np.bincount(at, minlength=len(n)))[:-1])


def prime_factors(x: Num) -> Column:
    """The prime factors of a whole number in order, repeated ones repeated; none below 2 and for null."""

    @F.pandas_udf("array<bigint>")
    def factors(n: pd.Series) -> pd.Series:
        return pd.Series(_factors_of(n.fillna(0).to_numpy().astype(np.int64)), dtype=object)

    # A null goes as 0, since a column with nulls would come as floating point numbers.
    return factors(F.coalesce(_c(x).cast("bigint"), F.lit(0).cast("bigint")))


def fibonacci(limit: Num) -> Column:
    """The Fibonacci numbers 0, 1, 1, 2, ... below ``limit``."""
    start = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(1).cast("bigint").alias("b"), F.array().cast("array<bigint>").alias("f"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, lambda s, _: F.when(s["a"] < _c(limit), F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b"), F.array_append(s["f"], s["a"]).alias("f"))).otherwise(s))
    return run["f"]


def rgb(x: Num) -> Column:
    """Struct (r, g, b) of ``#abc`` or ``aabbcc``; null for anything else."""
    h = F.lower(F.regexp_replace(_c(x), "^#", ""))
    full = F.when(h.rlike("^[0-9a-f]{3}$"), F.regexp_replace(h, "(.)(.)(.)", "$1$1$2$2$3$3")).when(h.rlike("^[0-9a-f]{6}$"), h)
    part = lambda k: F.conv(F.substring(full, k, 2), 16, 10).cast("int")
    return F.when(full.isNotNull(), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b")))


def min_max(x: Num, low: Column, high: Column) -> Column:
    """Scaled to 0..1; 1 if all values are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((_c(x) - low) / (high - low))


def random_int(low: int, high: int, seed: int = 17) -> Column:
    """A whole number from ``low`` to ``high``, both included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint")


def random_float(low: float = 0.0, high: float = 1.0, seed: int = 17) -> Column:
    """A number from ``low`` on, below ``high``."""
    return F.rand(seed) * (high - low) + low
