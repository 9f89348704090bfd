"""Random and deterministic filters of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import first_share


def bernoulli(df: DataFrame, ratio: float = 0.1, seed: int = 17, header: str | None = None) -> DataFrame:
    """Each row with a chance of ``ratio``; ``header``: a condition whose rows always stay."""
    keep = F.rand(seed) <= ratio
    return df.where(keep | F.expr(header) if header else keep)


def by_hash(df: DataFrame, key: str, ratio: float, seed: int = 17) -> DataFrame:
    """The rows whose key hashes below the ratio: the same rows however the data are partitioned."""
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(ratio * 1_000_000))


def by_digest(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Like ``by_hash`` with the last six digits of an MD5 digest, which other engines can repeat."""
    return df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 27, 6), 16, 10).cast("bigint") < int(ratio * 16**6))


def shuffled(df: DataFrame, seed: int = 17, percent: float | None = None) -> DataFrame:
    """All rows in random order, or exactly the first ``percent`` of them: a range-partitioned sort on a random key."""
    out = df.withColumn("__r", F.rand(seed))
    if percent is not None:
        out = first_share(out, "__r", round(percent / 100 * df.count()))
    return out.orderBy("__r").drop("__r")
