"""Column selection by field specifications, transposition, encodings and lookups of values."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import text
from tamarisk.plans.scale import PART, PREV, ordered_parts, with_offsets, with_previous


def parse_fields(spec: str, columns: Sequence[str]) -> list[int]:
    """1-based positions of a specification such as ``1,4-6,name,-2,8-``; order and repeats are kept.

    A name stands for its column wherever it appears whole; positions beyond the last column and unknown names raise ``ValueError``.
    """
    at = {c: i + 1 for i, c in enumerate(columns)}
    out: list[int] = []
    for item in filter(None, (p.strip() for p in spec.split(","))):
        if item in at:
            out.append(at[item])
            continue
        m = re.fullmatch(r"(\d+|[A-Za-z_]\w*)?\s*(-)?\s*(\d+|[A-Za-z_]\w*)?", item)
        if not m or not any(m.groups()):
            raise ValueError(f"bad field {item!r}")
        ends = []
        for given, default in ((m[1], 1), (m[3], len(columns))):
            if given is None:
                ends.append(default)
            elif given.isdigit():
                ends.append(int(given))
            elif given in at:
                ends.append(at[given])
            else:
                raise ValueError(f"unknown column {given!r}")
        out += range(ends[0], (ends[1] if m[2] else ends[0]) + 1)
    if bad := [i for i in out if not 1 <= i <= len(columns)]:
        raise ValueError(f"no such field: {bad}")
    return out


def _names(positions: Sequence[int], columns: Sequence[str]) -> list[tuple[int, str]]:
    """Positions with output names; a repeated column gets ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    out = []
    for p in positions:
        c = columns[p - 1]
        seen[c] = seen.get(c, 0) + 1
        out.append((p, c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return out


def cut(df: DataFrame, fields: str, blank_null: bool = True, most: int | None = None, one_line: bool = False) -> DataFrame:
    """The fields as text in the order asked for; nulls empty; ``most``: longer texts elided; ``one_line``: white space as blanks."""
    cols = []
    for p, name in _names(parse_fields(fields, df.columns), df.columns):
        c = F.col(f"`{df.columns[p - 1]}`").cast("string")
        c = F.coalesce(c, F.lit("")) if blank_null else c
        c = text.single_line(c) if one_line else c
        cols.append((text.elide(c, most) if most else c).alias(name))
    return df.select(*cols)


def exclude(df: DataFrame, fields: str) -> DataFrame:
    """All columns but those of the specification."""
    gone = {df.columns[p - 1] for p in parse_fields(fields, df.columns)}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in gone])


def delimited(df: DataFrame, sep: str = ",", name: str = "line") -> DataFrame:
    """Each row as one delimited line, quoted where needed."""
    return df.select(F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"sep": sep}).alias(name))


def unpivot_fields(df: DataFrame, key: str, elide: bool = False, mark: str = ".") -> DataFrame:
    """One row (key, field_no, field, value) for each field of each row, values as text; a narrow generator, no shuffle.

    ``elide``: a value equal to that of the row with the next smaller key becomes ``mark`` (one sort by field and key).
    """
    fields = [c for c in df.columns if c != key]
    cells = F.array(*[F.struct(F.lit(i + 1).alias("field_no"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for i, c in enumerate(fields)])
    out = df.select(key, F.inline(cells))
    return elide_repeats(out, "value", "field", [key], mark) if elide else out


def transpose(df: DataFrame, key: str, missing: str = "n/a") -> DataFrame:
    """One row (field_no, field, values) for each field with its values in key order, for tables small enough to be turned."""
    cells = unpivot_fields(df, key)
    turned = cells.groupBy("field_no", "field").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.coalesce("value", F.lit(missing)).alias("v")))).alias("c"))
    return turned.select("field_no", "field", F.transform("c", lambda x: x["v"]).alias("values"))


def elide_repeats(df: DataFrame, column: str, group: str, order: Sequence[str], mark: str = ".") -> DataFrame:
    """``column`` with ``mark`` where it repeats the row before it within ``group``."""
    rows = with_previous(df, group, list(order), [column])
    repeats = F.col(PREV).isNotNull() & F.col(PREV)[column].eqNullSafe(F.col(column))
    return rows.select(*[F.when(repeats, mark).otherwise(F.col(f"`{c}`")).alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])


def class_last(df: DataFrame, label: str, ignore: Sequence[str] = ()) -> DataFrame:
    """Columns without the ignored ones, the class as the last."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != label and c not in ignore], F.col(f"`{label}`"))


def as_doubles(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """All columns but ``keep`` as double, null where a text is no number."""

    def double(c: str, kind: str) -> Column:
        x = F.col(f"`{c}`")
        # The cast takes Java's suffixes (1d, 1f) and hexadecimals, which are no numbers.
        return (F.when(~x.rlike(r"(?i)x|[0-9.][df]\s*$"), x.try_cast("double")) if kind == "string" else x.try_cast("double")).alias(c)

    return df.select(*[F.col(f"`{c}`") if c in keep else double(c, kind) for c, kind in df.dtypes])


def first_value(df: DataFrame, wanted: str, key: str, order: str) -> DataFrame:
    """For every value of ``key`` the ``wanted`` value of its first row in ``order``: a lookup table (key, value)."""
    return df.groupBy(key).agg(F.min_by(F.struct(F.col(wanted).alias("v")), order)["v"].alias("value"))


def ids_by_appearance(df: DataFrame, label: str, order: str) -> DataFrame:
    """(label, id): ids from 0 in order of first appearance; nulls have none."""
    first = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.min(order).alias("__first"))
    return _ids(first, label, "__first", label)


def ids_by_name(df: DataFrame, label: str) -> DataFrame:
    """(label, id): ids from 0 in alphabetical order; nulls have none."""
    return _ids(df.where(F.col(label).isNotNull()).select(label).distinct(), label, label)


def _ids(labels: DataFrame, label: str, *order: str) -> DataFrame:
    """Ranges of labels are numbered each by one task and shifted by the labels before them, so no task sorts them all."""
    parts = with_offsets(ordered_parts(labels, *order), __before="1")
    row = F.expr(f"row_number() OVER (PARTITION BY {PART} ORDER BY {', '.join(f'`{c}`' for c in order)})")
    return parts.select(label, (F.col("__before") + row - 1).alias("id"))


def one_hot(df: DataFrame, label: str, values: Sequence[str]) -> DataFrame:
    """Adds an array with 1 at the place of the row's label, 0 elsewhere."""
    return df.withColumn(f"{label}_vector", F.array(*[F.when(F.col(label) == v, 1).otherwise(0) for v in values]))


def describe_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each numeric column: rows, nulls, mean, standard deviation, least and largest."""
    stats = F.array(*[F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("n"), F.sum(F.col(c).isNull().cast("long")).alias("nulls"), F.avg(c).alias("mean"), F.stddev(c).alias("sd"), F.min(F.col(c).cast("double")).alias("low"), F.max(F.col(c).cast("double")).alias("high")) for c in columns])
    return df.agg(stats.alias("s")).select(F.inline("s"))


def shown_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n``, the last ``n`` and ``n`` hash-chosen rows by a unique key, each with its ``part``: head, tail or sample. Three bounded top-k scans."""
    digest = F.md5(F.col(key).cast("string"))
    parts = [df.orderBy(key).limit(n).withColumn("part", F.lit("head")), df.orderBy(F.desc(key)).limit(n).withColumn("part", F.lit("tail")), df.orderBy(digest, key).limit(n).withColumn("part", F.lit("sample"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def as_column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
