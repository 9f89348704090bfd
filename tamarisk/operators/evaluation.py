"""Evaluation of classifiers and regressions by aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import PART, ordered_parts, with_offsets


def confusion(df: DataFrame, actual: str, predicted: str, values: Sequence[str]) -> DataFrame:
    """One row for each actual value with a column ``pred_<value>`` for each predicted one."""
    return df.groupBy(actual).agg(*[F.count(F.when(F.col(predicted) == v, 1)).alias(f"pred_{v}") for v in values])


def binary_scores(df: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1 and kappa; a ratio without a base is 0. Rows with a null are left out."""
    known = df.select(actual.cast("int").alias("a"), predicted.cast("int").alias("p")).where("a IS NOT NULL AND p IS NOT NULL")
    c = known.agg(*[F.count(F.when((F.col("a") == a) & (F.col("p") == p), 1)).alias(n) for n, a, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    out = c.withColumns({"accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})
    return out.withColumn("kappa", F.when(chance < 1, (F.col("accuracy") - chance) / (1 - chance)).otherwise(0.0))


def class_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """label, precision, recall, f1, support of every class that occurs."""
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = pairs.select(F.col("a").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("tp")).unionAll(pairs.select("p", F.lit(0).cast("long"), "n", F.lit(0).cast("long")))
    s = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "guessed", "tp")])
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    return s.select("label", ratio(F.col("tp"), F.col("guessed")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), "support")


def curve(df: DataFrame, actual: Column, score: Column) -> DataFrame:
    """threshold, tp, fp, precision, recall at every distinct score.

    Rows are counted by score first; the running sums go over ranges of scores, each taking on the sums of those before it.
    """
    by = df.select(actual.cast("int").alias("a"), (-score).alias("neg")).where("a IS NOT NULL AND neg IS NOT NULL").groupBy("neg").agg(F.sum("a").alias("p"), F.count(F.lit(1)).alias("n"))
    parts = with_offsets(ordered_parts(by, "neg"), p0="p", n0="n")
    over = f"OVER (PARTITION BY {PART} ORDER BY neg)"
    run = parts.withColumns({"tp": F.expr(f"p0 + sum(p) {over}"), "shown": F.expr(f"n0 + sum(n) {over}")})
    all_ = parts.agg(F.sum("p")).scalar()
    return run.select((-F.col("neg")).alias("threshold"), "tp", (F.col("shown") - F.col("tp")).alias("fp"), (F.col("tp") / F.col("shown")).alias("precision"), F.when(all_ > 0, F.col("tp") / all_).otherwise(0.0).alias("recall"))


def roc_auc(df: DataFrame, actual: Column, score: Column) -> DataFrame:
    """One row (auc): the chance that a positive scores above a negative, ties half; null without both."""
    by = df.select(actual.cast("int").alias("a"), score.alias("s")).where("a IS NOT NULL AND s IS NOT NULL").groupBy("s").agg(F.sum("a").alias("p"), F.count(F.lit(1)).alias("n"))
    parts = with_offsets(ordered_parts(by, "s"), q0="n - p")
    q = parts.withColumn("below", F.expr(f"q0 + sum(n - p) OVER (PARTITION BY {PART} ORDER BY s) - (n - p)"))
    won = F.sum(F.col("p") * (F.col("below") + (F.col("n") - F.col("p")) / 2))
    return q.agg((won / F.nullif(F.sum("p") * F.sum(F.col("n") - F.col("p")), F.lit(0))).alias("auc"))


def regression_line(df: DataFrame, y: str, x: str, by: Sequence[str] = ()) -> DataFrame:
    """slope, intercept, r2 and n of the least-squares line, for each group of ``by``."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def trailing_split(df: DataFrame, order: str, percent: float) -> DataFrame:
    """Adds ``part``: the last ``percent`` of the rows in the order of a unique column are ``test``, the rest ``train``; rows without a place in the order
    are neither (null).

    The split value is the exact rank found by counting ranges of the column, so no row is sorted globally.
    """
    n = df.where(F.col(order).isNotNull()).count()
    keep = n - -(-int(n * percent * 1000) // 100_000)
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    bins = 1024
    while lo is not None and hi > lo:
        width = max(1, -(-(hi - lo + 1) // bins))
        counts = df.where(F.col(order).between(lo, hi)).groupBy(F.floor((F.col(order) - lo) / width).alias("b")).count().orderBy("b").collect()
        below = df.where(F.col(order) < lo).count()
        for r in counts:
            if below + r["count"] >= keep:
                lo, hi = lo + int(r["b"]) * width, min(hi, lo + (int(r["b"]) + 1) * width - 1)
                break
            below += r["count"]
        if width == 1:
            break
    cut = lo if lo is not None else 0
    return df.withColumn("part", F.when(F.col(order) <= cut if keep > 0 else F.lit(False), "train").when(F.col(order).isNotNull(), "test"))


def threshold_sweep(df: DataFrame, actual: Column, score: Column, thresholds: Sequence[float]) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall and f1 of calling true what scores at least each threshold; one pass, one row for each."""
    known = df.select(actual.cast("int").alias("a"), score.alias("s")).where("a IS NOT NULL AND s IS NOT NULL")
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when((F.col("s") >= t) & (F.col("a") == 1), 1)).alias("tp"), F.count(F.when((F.col("s") >= t) & (F.col("a") == 0), 1)).alias("fp"), F.count(F.when((F.col("s") < t) & (F.col("a") == 1), 1)).alias("fn")) for t in thresholds])
    r = known.agg(rows.alias("r")).select(F.inline("r"))
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return r.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def mean_scores(report: DataFrame) -> DataFrame:
    """Means of precision, recall and f1 over the classes of ``class_report``, plain (macro) and by support (weighted)."""
    means = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.agg(F.count(F.lit(1)).alias("classes"), *means, *weighted)


def anova(df: DataFrame, y: str, group: str) -> DataFrame:
    """One row: groups, n, between and within (sums of squares), f and its degrees of freedom. One aggregation by group, one over the groups; rows with a
    null are left out."""
    g = df.where(F.col(y).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    t = g.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("between"))
    df1, df2 = F.col("groups") - 1, F.col("n") - F.col("groups")
    return t.withColumns({"df_between": df1, "df_within": df2, "f": F.when((df1 > 0) & (df2 > 0) & (F.col("within") > 0), (F.col("between") / df1) / (F.col("within") / df2))})
