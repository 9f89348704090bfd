"""Problem 4: filling missing values from similar records, with masks of what was filled.

Numeric fields follow a mixed-effects model: fixed effects of the covariates and of the class, then effects of time
period, outer group and inner group (here clinic and patient), each shrunk towards zero by ``n / (n + within / between)``
with the variances estimated from all rows. Categories follow a multinomial logit on the covariates, times shrunk category
shares of period, outer and inner group (the inner ones shrink towards the outer ones), relative to the overall shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarisk.plans.scale import lookup, written

#: A usable measurement within surrounding white space.
NUMBER = r"^(?U:\s*)([+-]?[0-9]+(?:\.[0-9]+)?)(?U:\s*)$"
#: Strengths among which the shrinkage of category shares is chosen by leave-one-out likelihood.
STRENGTHS = (0.02, 0.1, 0.5, 2.0, 10.0, 50.0, 250.0)


@dataclass(frozen=True)
class FillSpec:
    """What to fill and from what.

    ``numeric``: field -> (low, high), both included; ``category``: the field filled by the multinomial model and its
    usable ``values``; ``covariates``: complete or nearly complete numeric columns; ``outer``/``inner``: group columns;
    ``time``: timestamp whose month is the period; ``arrival``: of several deliveries of a key the first arrived counts;
    ``fit_rows``: the multinomial logit is fitted on about so many labelled rows, chosen by hash (all else uses all rows).
    """

    key: str
    numeric: dict[str, tuple[float, float]]
    category: str
    values: tuple[str, ...]
    covariates: tuple[str, ...]
    outer: str
    inner: str
    time: str
    arrival: str
    fit_rows: int = 50_000
    levels: tuple[str, ...] = field(default=("__period", "__outer", "__inner"))


def usable_number(c: Column | str, low: float, high: float) -> Column:
    """The number in the text, or null if it is no usable measurement within the bounds."""
    v = F.regexp_extract(F.col(c) if isinstance(c, str) else c, NUMBER, 1).try_cast("double")
    return F.when((v >= low) & (v <= high), v)


def usable_category(c: Column | str, values: tuple[str, ...]) -> Column:
    """The category in the text without surrounding white space, or null."""
    given = F.col(c) if isinstance(c, str) else c
    t = F.when(given.isin(*values), given).otherwise(F.regexp_replace(given, r"^(?U)\s+|(?U)\s+$", ""))
    return F.when(t.isin(*values), t)


def first_delivery(df: DataFrame, key: str, arrival: str) -> DataFrame:
    """One row for each key, that of the earliest arrival (ties: the smallest row). Rows without a key are all kept."""
    cols = df.columns
    rest = [c for c in cols if c not in (key, arrival)]
    one = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(arrival, *rest)).alias("__r")).select(*[F.col(c) if c == key else F.col(f"__r.`{c}`").alias(c) for c in cols])
    return one.unionByName(df.where(F.col(key).isNull()))


def fill_missing(df: DataFrame, spec: FillSpec) -> DataFrame:
    """One row for each record with all columns, the fields of ``spec`` filled, and ``<field>_filled`` masks.

    A mask is true where the value was missing and is filled, false where it was given, and null where it was missing and could not be
    filled, which is so for a field without a single usable value in the whole table. Numeric fields become double, clipped to their
    bounds; the category stays text. A record without group or period gets the effects that are known. Null, blank and unusable
    values count as missing. Rows without a key are records of their own. An empty table gives an empty one. Columns named like the
    masks are replaced.

    Plan: the records with their parsed values are written once to the shared folder, column by column, so that each pass reads what
    it needs; each effect level is one pre-aggregated pass over them with the smaller levels joined in; effects are broadcast only
    when they fit, else the join is salted, so that a clinic or patient with a third of the rows is spread over the tasks.
    """
    seen = Observation()
    stats = [*[F.avg(c).alias(f"m_{c}") for c in spec.covariates], *[F.stddev_pop(c).alias(f"sd_{c}") for c in spec.covariates], F.count(F.col("__k")).alias("labelled"), *[F.count(F.when(F.col("__k") == v, 1)).alias(f"n_{i}") for i, v in enumerate(spec.values)]]
    base = written(_parsed(first_delivery(df, spec.key, spec.arrival), spec).observe(seen, *stats))
    stats = seen.get
    means = {c: (float(stats[f"m_{c}"] or 0.0), float(stats[f"sd_{c}"] or 0.0) or 1.0) for c in spec.covariates}
    out, effects = _levels(_fixed(base, spec, means), spec, means, int(stats["labelled"]), [int(stats[f"n_{i}"]) for i in range(len(spec.values))])
    given, filled = {}, {}
    for f, (low, high) in spec.numeric.items():
        given[f] = F.col(f"__y_{f}")
        guess = F.col(f"__fix_{f}") + effects[f]
        filled[f] = F.coalesce(given[f], F.when(guess < low, float(low)).when(guess > high, float(high)).otherwise(guess))
    given[spec.category] = F.col("__k")
    filled[spec.category] = F.coalesce(F.col("__k"), F.col("__best"))
    masks = {f"{f}_filled": F.when(given[f].isNotNull(), False).when(filled[f].isNotNull(), True) for f in filled}
    keep = [c for c in df.columns if c not in masks]
    return out.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in keep], *[m.alias(c) for c, m in masks.items()])


def found(filled: DataFrame, spec: FillSpec) -> DataFrame:
    """The cells that were missing: one row (key, field) for each field that the fill marked as filled or as not to be filled."""
    fields = [*spec.numeric, spec.category]
    marked = F.array(*[F.when(F.coalesce(F.col(f"{f}_filled"), F.lit(True)), F.lit(f)) for f in fields])
    return filled.select(spec.key, F.explode_outer(marked).alias("field")).where("field IS NOT NULL")


def hidden(df: DataFrame, spec: FillSpec, share: int = 20) -> DataFrame:
    """How good the fills are: one in ``share`` of the usable values, chosen by the key's digest, is hidden and filled.

    field, hidden (cells), error (root mean squared error, or the share of wrong categories) and plain_error, that of the field's mean in the outer
    group (or its most frequent category), null without a usable value.
    """
    rows = first_delivery(df, spec.key, spec.arrival)
    fields = [*spec.numeric, spec.category]
    out_of = {f: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f), F.col(spec.key).cast("string"))), 1, 6), 16, 10).cast("long") % share == 0 for f in fields}
    truth = {f: usable_number(f, *b) for f, b in spec.numeric.items()} | {spec.category: usable_category(spec.category, spec.values)}
    kept = written(rows.select(*rows.columns, *[F.when(out_of[f], truth[f]).alias(f"__t_{f}") for f in fields]))
    blind = fill_missing(kept.select(*[F.when(~out_of[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns]), spec)
    plain = kept.groupBy(spec.outer).agg(*[F.avg(F.when(F.col(f"__t_{f}").isNull(), truth[f])).alias(f"__p_{f}") for f in spec.numeric], F.mode(F.when(F.col(f"__t_{spec.category}").isNull(), truth[spec.category]), True).alias(f"__p_{spec.category}"))
    both = lookup(kept.select(spec.key, spec.outer, *[f"__t_{f}" for f in fields]).join(blind.select(spec.key, *fields), spec.key), plain, [spec.outer])
    per = []
    for f in fields:
        t, g, p = F.col(f"__t_{f}"), F.col(f), F.col(f"__p_{f}")
        if f in spec.numeric:
            error, simple = F.sqrt(F.avg((g - t) * (g - t))), F.sqrt(F.avg((p - t) * (p - t)))
        else:
            error, simple = F.avg(F.when(t.isNotNull(), (g != t).cast("double"))), F.avg(F.when(t.isNotNull(), F.coalesce(p != t, F.lit(True)).cast("double")))
        per.append(F.struct(F.lit(f).alias("field"), F.count(t).alias("hidden"), error.alias("error"), simple.alias("plain_error")))
    return both.agg(F.array(*per).alias("r")).select(F.inline("r"))


def _parsed(df: DataFrame, spec: FillSpec) -> DataFrame:
    """The records with their usable values in place of the texts of the fields, and the groups of the effect levels."""
    cols = {f"__y_{f}": usable_number(f, *b) for f, b in spec.numeric.items()}
    cols |= {"__k": usable_category(spec.category, spec.values), "__period": F.year(spec.time) * 12 + F.month(spec.time), "__outer": F.col(spec.outer), "__inner": F.col(spec.inner)}
    return df.withColumns(cols).drop(*spec.numeric, spec.category)


def _fixed(df: DataFrame, spec: FillSpec, means: dict[str, tuple[float, float]]) -> DataFrame:
    """Adds ``__fix_<field>``, the least-squares prediction from covariates and category over all usable values."""
    fields, values, covs = list(spec.numeric), spec.values, list(spec.covariates)
    p = 1 + len(covs) + len(values)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {f: np.zeros((p + 1, p + 1)) for f in fields}
        for b in batches:
            x = np.ones((len(b), p))
            for i, c in enumerate(covs):
                m, sd = means[c]
                x[:, 1 + i] = ((b[c].astype(float) - m) / sd).fillna(0.0)
            for i, v in enumerate(values):
                x[:, 1 + len(covs) + i] = (b["__k"] == v).astype(float)
            for f in fields:
                y = b[f"__y_{f}"].to_numpy(dtype=float)
                ok = ~np.isnan(y)
                xy = np.column_stack([x[ok], y[ok]])
                total[f] += xy.T @ xy
        yield pd.DataFrame([(f, i, j, float(total[f][i, j])) for f in fields for i in range(p + 1) for j in range(p + 1)], columns=["f", "i", "j", "v"])

    rows = df.select(*covs, "__k", *[f"__y_{f}" for f in fields]).mapInPandas(sums, "f string, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect()
    gram = {f: np.zeros((p + 1, p + 1)) for f in fields}
    for r in rows:
        gram[r.f][r.i, r.j] = r.v
    cols = {}
    for f in fields:
        g = gram[f]
        if g[0, 0] == 0:
            cols[f"__fix_{f}"] = F.lit(None).cast("double")
            continue
        ridge = np.eye(p) * 1e-6 * max(g[0, 0], 1.0)
        ridge[0, 0] = 0.0
        beta = np.linalg.solve(g[:p, :p] + ridge, g[:p, p])
        e = F.lit(float(beta[0]))
        for i, c in enumerate(covs):
            m, sd = means[c]
            e = e + F.lit(float(beta[1 + i])) * F.coalesce((F.col(c).cast("double") - m) / sd, F.lit(0.0))
        # A record of unknown category takes none of the category effects; they are differences from it.
        for i, v in enumerate(values):
            e = e + F.when(F.col("__k") == v, float(beta[1 + len(covs) + i])).otherwise(0.0)
        cols[f"__fix_{f}"] = e
    return df.withColumns(cols)


def _levels(df: DataFrame, spec: FillSpec, means: dict[str, tuple[float, float]], labelled: int, counts: list[int]) -> tuple[DataFrame, dict[str, Column]]:
    """Joins, level by level, the shrunk effects of the numeric fields and the category counts; adds ``__best``, the most probable
    category (ties: the first of ``spec.values``). Returns the sum of the effects for each numeric field.

    One aggregation and one join for each level serve all fields.
    """
    fields, values = list(spec.numeric), spec.values
    w = _logit(df, spec, means, labelled) if labelled else None  # before the joins, which it does not need
    effects: dict[str, Column] = {f: F.lit(0.0) for f in fields}
    overall = [(n + 0.5) / (labelled + 0.5 * len(values)) for n in counts]
    prior: list[Column] = [F.lit(x) for x in overall]
    odds = [F.lit(0.0) for _ in values]
    for level in spec.levels:
        inner = level == "__inner"
        aggs = []
        for f in fields:
            r = F.col(f"__y_{f}") - F.col(f"__fix_{f}") - effects[f]
            aggs += [F.count(r).alias(f"n_{f}"), F.sum(r).alias(f"s_{f}"), F.sum(r * r).alias(f"q_{f}")]
        aggs += [F.count(F.when(F.col("__k") == v, 1)).alias(f"{level}_{i}") for i, v in enumerate(values)]
        if inner:
            aggs += [F.avg(F.when(F.col("__k").isNotNull(), p)).alias(f"{level}_p{i}") for i, p in enumerate(prior)]
        groups = written(df.where(F.col(level).isNotNull()).groupBy(level).agg(*aggs))

        # Variances between and within groups, and how well each strength predicts a record's category from the others of its group.
        m = [F.col(f"{level}_{i}") for i in range(len(values))]
        n = sum(m[1:], m[0])
        base = [F.col(f"{level}_p{i}") for i in range(len(values))] if inner else [F.lit(x) for x in overall]
        loo = [F.sum(sum((F.when(m[i] > 0, m[i] * F.log((m[i] - 1 + a * base[i]) / (n - 1 + a))).otherwise(0.0) for i in range(len(values))), F.lit(0.0))).alias(f"loo_{k}") for k, a in enumerate(STRENGTHS)]
        sums = [x for f in fields for x in (F.sum(f"n_{f}").alias(f"N_{f}"), F.count(F.when(F.col(f"n_{f}") > 0, 1)).alias(f"G_{f}"), F.sum(F.col(f"n_{f}") * F.col(f"n_{f}").cast("double")).alias(f"nn_{f}"), F.sum(f"s_{f}").alias(f"S_{f}"), F.sum(f"q_{f}").alias(f"Q_{f}"), F.sum(F.when(F.col(f"n_{f}") > 0, F.col(f"s_{f}") * F.col(f"s_{f}") / F.col(f"n_{f}"))).alias(f"B_{f}"))]
        tot = groups.agg(*sums, *loo, F.count(F.lit(1)).alias("groups")).first()
        shrunk = []
        for f in fields:
            ratio = _ratio(*(tot[f"{c}_{f}"] for c in ("N", "G", "nn", "S", "Q", "B")))
            e = F.col(f"s_{f}") / (F.col(f"n_{f}") + F.lit(float(ratio))) if ratio is not None else F.lit(0.0)
            shrunk.append(F.coalesce(e, F.lit(0.0)).alias(f"{level}_e_{f}"))
        df = lookup(df, groups.select(level, *shrunk, *[f"{level}_{i}" for i in range(len(values))]), [level], rows=None if isinstance(groups.schema[level].dataType, T.StringType) else int(tot["groups"]))
        effects = {f: effects[f] + F.coalesce(F.col(f"{level}_e_{f}"), F.lit(0.0)) for f in fields}

        a = STRENGTHS[max(range(len(STRENGTHS)), key=lambda k: -float("inf") if tot[f"loo_{k}"] is None else tot[f"loo_{k}"])]
        own = [F.coalesce(F.col(f"{level}_{i}"), F.lit(0)) for i in range(len(values))]
        total = sum(own[1:], own[0])
        share = [(own[i] + a * (prior[i] if inner else F.lit(overall[i]))) / (total + a) for i in range(len(values))]
        if level == "__outer":
            prior = share
        else:
            odds = [o + F.log(s) - F.log(F.lit(overall[i])) for i, (o, s) in enumerate(zip(odds, share))]
    if w is None:
        return df.withColumn("__best", F.lit(None).cast("string")), effects
    z = [F.lit(1.0), *[F.coalesce((F.col(c).cast("double") - means[c][0]) / means[c][1], F.lit(0.0)) for c in spec.covariates]]
    odds = [o + sum((F.lit(float(w[i, j])) * zj for j, zj in enumerate(z)), F.lit(0.0)) for i, o in enumerate(odds)]
    top = F.greatest(*odds) if len(odds) > 1 else odds[0]
    return df.withColumn("__best", F.coalesce(*[F.when(o == top, F.lit(v)) for o, v in zip(odds, values)])), effects


def _ratio(n: int | None, g: int | None, squares: float | None, total: float, square: float, between_sum: float) -> float | None:
    """Variance within over variance between groups, by moments; None if the groups do not differ."""
    if not n or not g or not n > g > 1:
        return None
    within = max((square - between_sum) / (n - g), 1e-12)
    between = (between_sum - total**2 / n - (g - 1) * within) / max(n - squares / n, 1e-12)
    return within / between if between > 0 else None


def _logit(df: DataFrame, spec: FillSpec, means: dict[str, tuple[float, float]], labelled: int) -> np.ndarray:
    """Weights of a multinomial logit, by Newton's method on a hashed sample of about ``spec.fit_rows`` labelled rows."""
    covs, values = list(spec.covariates), spec.values
    part = max(1, -(-labelled // spec.fit_rows))
    sample = df.where(F.col("__k").isNotNull() & (F.pmod(F.xxhash64(F.lit(7), spec.key), F.lit(part)) == 0)).select("__k", *covs).toPandas()
    k, d = len(values), 1 + len(covs)
    if not len(sample):
        return np.zeros((k, d))
    x = np.ones((len(sample), d))
    for j, c in enumerate(covs):
        x[:, 1 + j] = ((sample[c].astype(float) - means[c][0]) / means[c][1]).fillna(0.0)
    y = np.stack([(sample["__k"] == v).to_numpy(float) for v in values], axis=1)
    w = np.zeros((k, d))
    for _ in range(25):
        s = x @ w.T
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (y - p).T @ x - 1e-3 * w
        hess = np.zeros((k * d, k * d))
        for a in range(k):
            for b in range(k):
                h = p[:, a] * ((a == b) - p[:, b])
                hess[a * d : (a + 1) * d, b * d : (b + 1) * d] = (x * h[:, None]).T @ x
        step = np.linalg.solve(hess + 1e-3 * np.eye(k * d), grad.ravel()).reshape(k, d)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w
