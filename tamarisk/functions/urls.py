"""URL functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quote(x: Col, idempotent: bool = False) -> Column:
    """Percent-encoded with ``+`` for blanks; ``idempotent``: what is already encoded stays."""
    c = F.url_encode(_c(x))
    c = F.replace(c, F.lit("*"), F.lit("%2A"))
    return F.replace(F.replace(c, F.lit("%2B"), F.lit("+")), F.lit("%25"), F.lit("%")) if idempotent else c


def unquote(x: Col) -> Column:
    """Decoded; null if it is not validly encoded."""
    return F.try_url_decode(_c(x))


def params(url: Col) -> Column:
    """The query parameters as a map, values decoded, of repeated ones the last, ``-`` in names as ``_``."""
    pairs = F.filter(F.split(F.regexp_extract(_c(url), r"\?([^#]*)", 1), "&"), lambda p: p.contains("="))
    entries = F.transform(pairs, lambda p: F.struct(F.replace(F.substring_index(p, "=", 1), F.lit("-"), F.lit("_")).alias("key"), F.coalesce(F.try_url_decode(F.regexp_replace(p, "^[^=]*=", "")), F.lit("")).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def param(url: Col, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(params(url), F.lit(name.replace("-", "_"))), F.lit(default))


def misc_params(text: Col) -> Column:
    """``k=v, k2=v2`` as a map."""
    return F.transform_values(F.transform_keys(F.str_to_map(_c(text), F.lit(","), F.lit("=")), lambda k, _: F.trim(k)), lambda _, v: F.trim(v))


def param_bool(url: Col, name: str, default: bool = False) -> Column:
    """True for ``1``, ``on``, ``true``, ``yes`` and ``y`` in any case."""
    v = F.try_element_at(params(url), F.lit(name.replace("-", "_")))
    return F.when(v.isNull(), F.lit(default)).otherwise(F.lower(v).isin("1", "on", "true", "yes", "y"))


def param_number(url: Col, name: str, default: float = 0, kind: str = "int") -> Column:
    """The parameter as ``int`` or ``double``, ``default`` where it is none."""
    return F.coalesce(F.try_element_at(params(url), F.lit(name.replace("-", "_"))).try_cast(kind), F.lit(default).cast(kind))
