"""Problem 2: frequency of every distinct term (or n-gram of terms), by suffix-sorted counting.

Every position of a text gives the suffix that starts there, truncated to ``max_n`` terms. Suffixes are routed by their first
term, sorted in reverse lexicographic order, and one pass with a stack of at most ``max_n`` entries yields the counts of all
prefixes, which are all n-grams. The set of records holding an n-gram is kept as a count: a suffix carries the length from
which its prefixes occur for the first time in their record, so each record is counted once for each n-gram and the counts add
up over batches, tasks and salts without any set in memory.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A term: a maximal run of letters, marks and digits.
TERM = r"[\p{L}\p{M}\p{N}]+"
#: Shares into which the suffixes of one first term are split, by their second term.
SALTS = 8
#: Distinct suffixes that one task combines before it passes them on.
COMBINE = 200_000


def terms(text):
    """The terms of the lower-cased text as an array; null for a null text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def one_record(df: DataFrame, key: str, text: str, arrival: str | None = None) -> DataFrame:
    """(key, text) once for each key, that of the earliest arrival. Rows without a key are records of their own."""
    by = F.struct(*([F.col(arrival)] if arrival else []), F.col(text))
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(by).alias("r")).select(key, F.col(f"r.`{text}`").alias(text))
    return one.unionByName(df.where(F.col(key).isNull()).select(key, text))


#: Bits of one count where the counts of a suffix are kept in one whole number, so that adding them is one addition.
BITS = 48
_ONE = (1 << BITS) - 1


def count_ngrams(df: DataFrame, text: str = "text", max_n: int = 1, sizes: Collection[int] | None = None) -> DataFrame:
    """ngram, n, occurrences, records of every n-gram of up to ``max_n`` terms over all rows of ``df``, each row a record.

    ``sizes``: only n-grams of so many terms are given, though all are counted. Null texts, and texts without terms, hold no n-gram. Terms of an
    n-gram are joined by a blank and may be separated by anything in the text. Other columns are ignored. No rows give no rows.

    Scale: identical suffixes are combined before the shuffle, so a text repeated in a third of the rows costs one row for
    each task; the suffixes of a hot first term go to up to SALTS tasks and their partial counts are added at the end.
    """
    given = frozenset(range(1, max_n + 1) if sizes is None else sizes)
    # A suffix carries how often it occurs and, for each length, how often its prefixes are new to their record from that length on.
    fields = ["c", *(f"new{n}" for n in range(1, max_n + 1))]

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[str, int] = defaultdict(int)
        step = [1, *(1 + (1 << BITS * n) for n in range(1, max_n + 1))]
        for batch in batches:
            for words in batch.column(0).to_pylist():
                if not words:
                    continue
                seen: set[str] = set()
                add = seen.add
                last = len(words)
                for i, part in enumerate(words):
                    new = 0
                    if part not in seen:
                        add(part)
                        new = 1
                    for n in range(2, min(max_n, last - i) + 1):
                        part = f"{part} {words[i + n - 1]}"
                        # Where a prefix is new, so is what it begins.
                        if new:
                            add(part)
                        elif part not in seen:
                            add(part)
                            new = n
                    held[part] += step[new]
            if len(held) >= COMBINE:
                yield flush(held)
                held.clear()
        if held:
            yield flush(held)

    def flush(held: dict[str, int]) -> pa.RecordBatch:
        counts = list(held.values())
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), *(pa.array([x >> BITS * k & _ONE for x in counts], pa.int64()) for k in range(max_n + 1))], ["suffix", *fields])

    def stack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # words: the terms on the stack; sums: of each depth the counts of the suffixes whose prefix it is.
        words: list[str] = []
        sums: list[int] = []
        out: tuple[list, list, list, list] = ([], [], [], [])

        def pop(keep: int) -> None:
            while len(words) > keep:
                d, x = len(words), sums.pop()
                if d in given:
                    for column, v in zip(out, (" ".join(words), d, x & _ONE, sum(x >> BITS * n & _ONE for n in range(1, d + 1)))):
                        column.append(v)
                words.pop()
                if sums:
                    sums[-1] += x

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for suffix, *counts in zip(*columns):
                parts = suffix.split(" ")
                same = 0
                for a, b in zip(words, parts):
                    if a != b:
                        break
                    same += 1
                if len(words) > same:
                    pop(same)
                for p in parts[same:]:
                    words.append(p)
                    sums.append(0)
                sums[-1] += sum(x << BITS * k for k, x in enumerate(counts) if x)
            if len(out[0]) >= 50_000:
                yield made(out)
                for column in out:
                    column.clear()
        pop(0)
        yield made(out)

    def made(out: tuple[list, list, list, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["ngram", "n", "occurrences", "records"])

    counted = df.select(terms(F.col(text)).alias("w")).mapInArrow(suffixes, "suffix string, " + ", ".join(f"{c} bigint" for c in fields))
    first, second = F.substring_index("suffix", " ", 1), F.substring_index(F.substring_index("suffix", " ", 2), " ", -1)
    routed = counted.withColumn("first", first).withColumn("salt", F.pmod(F.hash(second), F.lit(SALTS))).repartition("first", "salt")
    ordered = routed.sortWithinPartitions(F.col("first").desc(), F.col("suffix").desc()).select("suffix", *fields)
    part = ordered.mapInArrow(stack, "ngram string, n int, occurrences bigint, records bigint")
    return part.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, records: int, rare_below: int = 3, common_above_pct: int = 24) -> DataFrame:
    """Adds ``mark``: ``rare`` for n-grams in fewer than ``rare_below`` records, else ``common`` for those in more than
    ``common_above_pct`` percent of ``records``, else null."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * 100 > F.lit(records * common_above_pct), "common")
    return counts.withColumn("mark", mark)


def record_count(df: DataFrame, key: str, text: str, arrival: str | None = None) -> int:
    """Number of records of ``one_record`` with a non-null text, without moving any text."""
    by = F.struct(*([F.col(arrival)] if arrival else []), F.col(text).isNotNull().alias("t"))
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(by).alias("r")).where("r.t").count()
    return keyed + df.where(F.col(key).isNull() & F.col(text).isNotNull()).count()
