"""Products of matrices in long form (i, j, v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import lookup


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of A times B: one join on the inner index, of which a hot one is spread over tasks, and one aggregation; absent cells are zero."""
    x = a.groupBy("i", "j").agg(F.sum("v").alias("v")).select("i", F.col("j").alias("k"), F.col("v").alias("a"))
    y = b.groupBy("i", "j").agg(F.sum("v").alias("v")).select(F.col("i").alias("k"), "j", F.col("v").alias("b"))
    return lookup(x, y, ["k"], "inner").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def gram(df: DataFrame, column: str, width: int) -> DataFrame:
    """(i, j, v) of X'X over array rows of ``width`` numbers: each task adds up its own product, so ``width`` squared rows leave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            rows = [np.asarray(v, dtype=float) for v in b.column(0).to_pylist() if v is not None and len(v) == width]
            if rows:
                x = np.vstack(rows)
                total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel(), pa.float64())], ["i", "j", "v"])

    return df.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
