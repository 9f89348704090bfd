"""Lookups in tables, transitive closure, nearest colours and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.functions import numbers
from tamarisk.plans.scale import PART, fits, lookup, ordered_parts, written


def lookup_table(lines: DataFrame, line: str = "line", order: str = "line_no", sep: str = "\t", retain_case: bool = False, comments: bool = False) -> DataFrame:
    """(key, value) of delimited lines: split at the first ``sep``, lower-cased unless ``retain_case``; the last line of a key wins."""
    c = F.regexp_replace(line, r"[;#].*$", "") if comments else F.col(line)
    c = c if retain_case else F.lower(c)
    parts = lines.select(F.col(order).alias("__o"), F.split(c, f"\\Q{sep}\\E", 2).alias("p")).where("size(p) = 2")
    return parts.groupBy(F.trim(F.col("p")[0]).alias("key")).agg(F.max_by(F.col("p")[1], "__o").alias("value"))


def boolean_table(lines: DataFrame, line: str = "line", sep: str = "\t") -> DataFrame:
    """The distinct first fields, trimmed and lower-cased, as (key)."""
    return lines.select(F.lower(F.trim(F.split(line, f"\\Q{sep}\\E")[0])).alias("key")).where("key <> ''").distinct()


def frequency_table(lines: DataFrame, line: str = "line", order: str = "line_no", fields: int = 2) -> DataFrame:
    """(word, [pos,] freq) of tab-separated lines: comments and other field counts are skipped, the first line of a word wins; freq stays text."""
    p = lines.where(~F.col(line).startswith("#")).select(F.col(order).alias("__o"), F.split(line, "\t").alias("p")).where(F.size("p") == fields)
    names = ("word", "freq") if fields == 2 else ("word", "pos", "freq")
    rows = p.select("__o", F.lower(F.trim(F.col("p")[0])).alias("word"), *[F.col("p")[i].alias(n) for i, n in enumerate(names) if i])
    return rows.groupBy("word").agg(F.min_by(F.struct(*names[1:]), "__o").alias("r")).select("word", "r.*")


def with_default(df: DataFrame, table: DataFrame, key: Column, default: str, name: str = "value") -> DataFrame:
    """Adds the value that the lower-cased ``key`` has in (key, value), else ``default``."""
    keyed = df.withColumn("__k", F.lower(key))
    t = table.select(F.col("key").alias("__k"), F.col("value").alias(name))
    return lookup(keyed, t, ["__k"]).withColumn(name, F.coalesce(name, F.lit(default))).drop("__k")


def not_listed(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    """Rows whose token is not in the dictionary (column of the same name)."""
    return lookup(tokens, dictionary.select(token).distinct(), [token], "left_anti")


def listed(tokens: DataFrame, dictionary: DataFrame, token: str = "token") -> DataFrame:
    return lookup(tokens, dictionary.select(token).distinct(), [token], "left_semi")


def closure(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """All pairs joined by a path, by path doubling: each round joins the newest pairs with all pairs, so a path of n edges
    takes log n rounds. Cycles end when nothing is new. Each round is written to the shared folder."""
    pairs = written(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    new = pairs
    while not new.isEmpty():
        left = new.alias("a").join(pairs.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        right = pairs.alias("a").join(new.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        new = written(left.union(right).distinct().join(pairs, ["src", "dst"], "left_anti"))
        pairs = written(pairs.union(new))
    return pairs


#: Colours that a palette may have to be compared in one array; larger ones are refused.
MAX_PALETTE = 10_000


def nearest_colour(df: DataFrame, palette: DataFrame, hex_column: str) -> DataFrame:
    """Adds the name and squared distance of the palette colour (name, hex) nearest in RGB; ties go to the smaller name.

    The palette, of checked size, is one literal array that each row is compared with: no join.
    """
    if not fits(palette, MAX_PALETTE):
        raise ValueError(f"more than {MAX_PALETTE} colours")
    rows = palette.select("name", numbers.rgb("hex").alias("c")).where("c IS NOT NULL").collect()
    colours = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["c"]["r"]).alias("r"), F.lit(r["c"]["g"]).alias("g"), F.lit(r["c"]["b"]).alias("b")) for r in rows])
    c = F.col("__c")
    square = lambda a, b: (a - b) * (a - b)
    far = F.transform(colours, lambda p: F.struct((square(p["r"], c["r"]) + square(p["g"], c["g"]) + square(p["b"], c["b"])).alias("d"), p["name"].alias("name")))
    best = df.withColumn("__c", numbers.rgb(hex_column)).withColumn("__b", F.array_min(far))
    return best.select(*df.columns, F.when(F.col("__c").isNotNull(), F.col("__b")["name"]).alias("colour"), F.when(F.col("__c").isNotNull(), F.col("__b")["d"]).alias("distance"))


def latest_before(df: DataFrame, other: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """As-of lookup: adds the ``value`` of the latest row of ``other`` (key, ts, value) at or before each row of ``df`` (key, ts).

    Both sides are merged into one order of (key, ts), cut into ranges, and the last value is carried forward within each; a range
    that starts amid a key takes on what the ranges before it carry. No range join, and a hot key is spread over tasks. Of
    rows of ``other`` with the same key and time the largest value counts; rows of ``df`` with a null key or time find nothing.
    """
    kind = dict(other.dtypes)[value]
    found = other.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(key, ts).agg(F.max(value).alias("__v"))
    able = F.col(key).isNotNull() & F.col(ts).isNotNull()
    a = df.where(able).withColumns({"__side": F.lit(1), "__v": F.lit(None).cast(kind)})
    parts = ordered_parts(a.unionByName(found.withColumn("__side", F.lit(0)), allowMissingColumns=True), key, ts, "__side")
    over = f"PARTITION BY {PART}, `{key}` ORDER BY `{ts}`, __side ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    filled = parts.withColumn("__w", F.expr(f"last_value(__v) IGNORE NULLS OVER ({over})"))
    # What each part passes on for its last key, and what it takes on for its first: as many rows as there are parts.
    ends = parts.groupBy(PART).agg(F.min(key).alias("__first"), F.max(key).alias("__last"), F.max(F.when(F.col("__v").isNotNull(), F.struct(key, ts, "__v"))).alias("__m"))
    carry = ends.select(F.col(PART).alias("__from"), F.col("__last").alias(key), F.when(F.col("__m")[key] == F.col("__last"), F.col("__m")["__v"]).alias("__c")).where("__c IS NOT NULL")
    takes = ends.select(PART, F.col("__first").alias(key)).join(carry, key).where(f"__from < {PART}").groupBy(PART, key).agg(F.max_by("__c", "__from").alias("__c"))
    joined = filled.where("__side = 1").join(F.broadcast(takes), [PART, key], "left").withColumn(f"latest_{value}", F.coalesce("__w", "__c"))
    return joined.select(*df.columns, f"latest_{value}").unionByName(df.where(~able).withColumn(f"latest_{value}", F.lit(None).cast(kind)))


def pairs_table(lines: DataFrame, line: str = "line", order: str = "line_no", use_line: bool = False) -> DataFrame:
    """(key, value) of lines with exactly one tab, keys in lower case, the last line of a key winning; ``use_line``: a line without a
    tab has its number as key."""
    p = lines.select(F.col(order).alias("__o"), F.split(line, "\t").alias("p"))
    key = F.when(F.size("p") == 2, F.lower(F.col("p")[0])).when(F.lit(use_line) & (F.size("p") == 1), F.col("__o").cast("string"))
    rows = p.select("__o", key.alias("key"), F.element_at("p", -1).alias("value")).where("key IS NOT NULL")
    return rows.groupBy("key").agg(F.max_by("value", "__o").alias("value"))


def relabel(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``column`` as its value in (key, value), unchanged where the table lacks it."""
    t = table.select(F.col("key").alias(column), F.col("value").alias("__v"))
    return lookup(df, t, [column]).withColumn(column, F.coalesce("__v", column)).drop("__v").select(*df.columns)


def missing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that ``b`` lacks, repeated rows counted: empty iff a conversion kept everything."""
    return a.select(*b.columns).exceptAll(b)
