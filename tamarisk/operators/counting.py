"""Pattern extraction, counting, and frequency tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(column: Column | str, pattern: str, group: int = 0, first_only: bool = False) -> Column:
    """All matches (or the first) of a pattern as an array; a pattern without a match gives an empty array."""
    found = F.regexp_extract_all(F.col(column) if isinstance(column, str) else column, F.lit(pattern), F.lit(group))
    return F.slice(found, 1, 1) if first_only else found


def match_groups(column: Column | str, pattern: str, groups: int) -> Column:
    """Array of structs g1..gn, one for each match."""
    parts = [matches(column, pattern, k + 1).alias(f"g{k + 1}") for k in range(groups)]
    return F.arrays_zip(*parts)


def count_it(df: DataFrame, column: str, pattern: str, group: int = 0, first_only: bool = False) -> DataFrame:
    """(value, freq) of all matches of a pattern."""
    return df.select(F.explode_outer(matches(column, pattern, group, first_only)).alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("freq"))


def normalized(freq: DataFrame, value: str = "freq") -> DataFrame:
    """Adds share, the value over the sum of all; the sum is a scalar subquery, so the rows stay where they are."""
    total = freq.agg(F.sum(value)).scalar()
    return freq.withColumn("share", F.when(total > 0, F.col(value) / total).otherwise(F.col(value)))


def top(df: DataFrame, value: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The ``k`` largest (or smallest) values; ties by ``tie``."""
    return df.orderBy(F.desc(value) if descending else F.asc(value), tie).limit(k)


def document_frequency(df: DataFrame, key: str, terms: Column) -> DataFrame:
    """(term, df, freq) over arrays of terms."""
    t = df.select(key, F.explode_outer(terms).alias("term")).where("term IS NOT NULL").groupBy("term", key).agg(F.count(F.lit(1)).alias("c"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("c").alias("freq"))


def bag_of_words(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, token, n): tokens are what non-word characters separate in the lower-cased text, empty ones included."""
    return df.where(F.col(text).isNotNull()).select(key, F.explode(F.split(F.lower(text), r"[^a-z0-9_]+", -1)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"))


def keyword_filter(terms: DataFrame, n: int, include: DataFrame | None = None, exclude: DataFrame | None = None, low: float = 0, high: float = 1.0) -> DataFrame:
    """Terms in ``include``, not in ``exclude`` and with df in bounds, which below 1 (``high``: up to 1) are shares of ``n``."""
    out = terms
    if include is not None:
        out = out.join(include, "term", "left_semi")
    if exclude is not None:
        out = out.join(exclude, "term", "left_anti")
    return out.where((F.col("df") >= F.lit(low * n if low < 1 else low)) & (F.col("df") <= F.lit(high * n if high <= 1 else high)))


def keyword_stats(top_terms: DataFrame, key: str = "doc_id", limit: int = 3) -> tuple[DataFrame, DataFrame]:
    """Of ranked terms: (documents, keywords, distinct keywords, mean of the documents' mean score), and the most frequent keyword sets."""
    per = top_terms.where(F.col("rank") <= limit).groupBy(key).agg(F.count(F.lit(1)).alias("k"), F.avg("score").alias("m"), F.array_join(F.array_sort(F.collect_list("ngram")), ", ").alias("keyword_set"))
    distinct = top_terms.where(F.col("rank") <= limit).agg(F.countDistinct("ngram")).scalar()
    summary = per.agg(F.count(F.lit(1)).alias("documents"), F.sum("k").alias("keywords"), F.avg("m").alias("mean_score")).withColumn("distinct_keywords", distinct)
    return summary, per.groupBy("keyword_set").agg(F.count(F.lit(1)).alias("documents"))


def rolled_up(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Sums of a value over all prefixes of ``by``; ``level`` is the number of columns summed over."""
    return df.rollup(*by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"), F.bit_count(F.grouping_id()).cast("int").alias("level"))


def prefix_stats(df: DataFrame, column: str, min_parts: int = 5, min_length: int = 40) -> DataFrame:
    """(prefix, n, score) of the directory prefixes of the paths in a column that occur more than once; score is length times count."""
    path = F.explode(F.regexp_extract_all(F.col(column), F.lit(r"(?:/[\w.\-]+){" + str(min_parts) + r",}"), F.lit(0))).alias("path")
    parts = df.select(path).select(F.split("path", "/").alias("p"))
    prefix = F.explode(F.transform(F.sequence(F.lit(2), F.size("p")), lambda k: F.array_join(F.slice("p", 1, k), "/"))).alias("prefix")
    counts = parts.select(prefix).where(F.length("prefix") >= min_length).groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.withColumn("score", F.length("prefix") * F.col("n"))
