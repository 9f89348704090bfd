"""Problem 7: filling fixed-capacity containers by bounded-space online best fit.

Items come one by one. A fixed number of bins is open, kept in a bitset by their free space, so that the bin with the least
room that still takes the item is one bit scan away. If none takes it a new bin opens, and if too many are open the fullest
closes first. A bin without room closes at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import checkpoint, fits

#: Bins that are open at once.
OPEN_BINS = 128
#: Size units that one task packs; what its last open bins leave free is small against it.
TASK_UNITS = 64_000_000
#: Plans are collected to plan the work; more are refused.
MAX_PLANS = 1000


class BestFit:
    """Bounded-space best fit for one capacity; bins are numbered from 0."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.most = capacity, open_bins
        self.bits = 0  # bit f is set iff an open bin has f units free
        self.at: dict[int, list[int]] = {}  # free space -> open bins
        self.open = self.made = 0

    def put(self, size: int) -> int:
        """The bin that takes an item of 1 to ``capacity`` units."""
        fit = self.bits >> size
        if fit:
            free = size + (fit & -fit).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most and size < self.capacity:  # a full item's bin is never open
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, bin_ = self.capacity, self.made
            self.made += 1
        if free > size:
            rest = free - size
            self.at.setdefault(rest, []).append(bin_)
            self.bits |= 1 << rest
            self.open += 1
        return bin_

    def _take(self, free: int) -> int:
        bins = self.at[free]
        b = bins.pop()
        if not bins:
            del self.at[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return b


def _bounded(plans: DataFrame) -> DataFrame:
    if not fits(plans, MAX_PLANS):
        raise ValueError(f"more than {MAX_PLANS} plans")
    return plans


def kinds(plans: DataFrame) -> list[str]:
    """The kinds of sizes that the plans pack."""
    return sorted(r.kind for r in _bounded(plans).where("kind IS NOT NULL").select("kind").distinct().collect())


def pack(sizes: DataFrame, plans: DataFrame, key: str = "doc_id", open_bins: int = OPEN_BINS, task_units: int = TASK_UNITS) -> DataFrame:
    """plan_id, ``key``, piece, start, units, container for every item of ``sizes`` (key, kind, units) under every plan.

    ``plans`` has plan_id, kind (which sizes it packs) and capacity. An item larger than the capacity is cut: full pieces take
    a container each, the rest is packed like any item; ``piece`` counts from 1 and ``start`` is the unit a piece begins at.
    Items of no (or null) units need no place and give no row, nor do plans with a capacity below 1. Repeated keys are items
    of their own. Container numbers are unique within a plan and repeat exactly if a task is run again.

    Scale: items are dealt by hash to as many tasks as there are ``task_units`` in all; each packs its stream in the order of
    the keys, holding ``open_bins`` bins, whatever the number of items.
    """
    wanted = [(int(r.plan_id), r.kind, int(r.capacity)) for r in _bounded(plans).where("plan_id IS NOT NULL AND capacity >= 1").select("plan_id", "kind", "capacity").collect()]
    spark, kind = sizes.sparkSession, dict(sizes.dtypes)[key]
    schema = f"plan_id int, `{key}` {kind}, piece int, start bigint, units bigint, container bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    sizes = checkpoint(sizes.where("units > 0").select(key, "kind", "units"))
    total = {r.kind: int(r.n) for r in sizes.groupBy("kind").agg(F.sum("units").alias("n")).collect()}
    shares = {p: max(1, -(-total.get(k, 0) // task_units)) for p, k, _ in wanted}
    capacity = {p: c for p, _, c in wanted}
    plan = F.explode(F.array(*[F.struct(F.lit(p).alias("plan_id"), F.lit(k).alias("k"), F.lit(shares[p]).alias("shares")) for p, k, _ in wanted]))
    items = sizes.select("*", plan.alias("p")).where("kind = p.k").select(F.col("p.plan_id"), F.pmod(F.xxhash64(key), F.col("p.shares")).alias("share"), key, "units")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fit, cap = None, None, 0
        for frame in frames:
            out: list[tuple] = []
            for p, share, k, units in zip(frame["plan_id"].tolist(), frame["share"].tolist(), frame[key].tolist(), frame["units"].tolist()):
                if (p, share) != now:
                    now, cap = (p, share), capacity[p]
                    fit = BestFit(cap, open_bins)
                start, piece = 0, 1
                while start < units:
                    n = min(cap, units - start)
                    out.append((p, k, piece, start, n, (share << 32) + fit.put(n)))
                    start, piece = start + n, piece + 1
            yield pd.DataFrame(out, columns=["plan_id", key, "piece", "start", "units", "container"])

    dealt = items.repartition(max(1, sum(shares.values())), "plan_id", "share").sortWithinPartitions("plan_id", "share", key, "units")
    return dealt.mapInPandas(run, schema)


def fill(packed: DataFrame, plans: DataFrame) -> DataFrame:
    """For each plan: containers, units packed, pieces, and the share of the room that is used."""
    per = packed.groupBy("plan_id").agg(F.countDistinct("container").alias("containers"), F.sum("units").alias("units"), F.count(F.lit(1)).alias("pieces"))
    return plans.select("plan_id", "capacity").join(per, "plan_id").withColumn("filled", F.col("units") / (F.col("containers") * F.col("capacity")))


def checked(packed: DataFrame, sizes: DataFrame, plans: DataFrame, filled: float, key: str = "doc_id", open_bins: int = OPEN_BINS) -> DataFrame:
    """For each plan: ``whole`` (the pieces of every item follow each other from its first unit to its last), ``within`` (no container over its
    capacity) and ``filled`` (at least that share of the room of all containers is used, but for as many as may be open at the end). Keys are taken
    to be unique."""
    pieces = packed.groupBy("plan_id", key).agg(F.sum("units").alias("got"), F.max(F.col("start") + F.col("units")).alias("end"), F.count(F.lit(1)).alias("n"), F.max("piece").alias("last"))
    want = plans.select("plan_id", "kind").join(sizes.where("units > 0"), "kind").select("plan_id", key, "units")
    whole = want.join(pieces, ["plan_id", key], "full").groupBy("plan_id").agg(F.min(F.coalesce((F.col("got") == F.col("units")) & (F.col("end") == F.col("units")) & (F.col("n") == F.col("last")), F.lit(False))).alias("whole"))
    rooms = packed.groupBy("plan_id", "container").agg(F.sum("units").alias("u")).groupBy("plan_id").agg(F.max("u").alias("most"), F.sum("u").alias("u"), F.count(F.lit(1)).alias("c"))
    out = plans.select("plan_id", "capacity").join(whole, "plan_id").join(rooms, "plan_id")
    return out.select("plan_id", "whole", (F.col("most") <= F.col("capacity")).alias("within"), (F.col("u") >= F.lit(filled) * (F.col("c") - open_bins) * F.col("capacity")).alias("filled"))
