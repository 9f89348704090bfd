"""Problem 1: samples that match target category proportions, by controlled rounding and exact random-key quotas.

For every plan the rows requested of each class are split over strata in proportion to the records there. That quota table
is fractional; it is made whole by a maximum flow in which every cell becomes its floor or ceiling, every class total stays
what it was, and every stratum total becomes its own floor or ceiling. Each cell then gives the records with the smallest
random keys, exactly as many as its quota.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.plans.scale import lookup, written

#: Strata are hashed to so many, which bounds the quota table by plans x classes x STRATA cells.
STRATA = 32
#: Ranges of the random key that are counted for each cell before the boundary range alone is ranked.
KEY_RANGES = 4096


def round_table(cells: dict[tuple[str, int], Fraction]) -> dict[tuple[str, int], int]:
    """Whole cells for a table with whole row sums: each the floor or ceiling, row sums kept, column sums floor or ceiling.

    Units left over by rounding down flow from rows through cells with a fraction (one unit each) to columns; columns are
    first filled to the floor of their sum, then up to the ceiling. A fractional flow exists, so a whole one does.
    """
    whole = {k: v.numerator // v.denominator for k, v in cells.items()}
    rows: dict[str, Fraction] = {}
    cols: dict[int, Fraction] = {}
    for (r, c), v in cells.items():
        rows[r] = rows.get(r, Fraction(0)) + v - whole[r, c]
        cols[c] = cols.get(c, Fraction(0)) + v - whole[r, c]
    left = {r: int(v) for r, v in rows.items()}
    free = {r: sorted(c for (q, c), v in cells.items() if q == r and v > whole[q, c]) for r in rows}
    used: dict[int, set[str]] = {c: set() for c in cols}  # rows that send a unit to the column
    load = dict.fromkeys(cols, 0)

    def push(row: str, room: dict[int, int]) -> bool:
        came: dict[int, str] = {}
        via: dict[str, int] = {}
        queue, seen = [row], {row}
        while queue:
            r = queue.pop(0)
            for c in free[r]:
                if c in came or r in used[c]:
                    continue
                came[c] = r
                if load[c] < room[c]:
                    load[c] += 1
                    while True:
                        used[c].add(came[c])
                        if came[c] == row:
                            return True
                        back = via[came[c]]
                        used[back].discard(came[c])
                        c = back
                for s in sorted(used[c]):
                    if s not in seen:
                        seen.add(s)
                        via[s] = c
                        queue.append(s)
        return False

    for room in ({c: int(v) for c, v in cols.items()}, {c: -(-v.numerator // v.denominator) for c, v in cols.items()}):
        for r in sorted(left):
            while left[r] and push(r, room):
                left[r] -= 1
    if any(left.values()):
        raise AssertionError(f"no whole table: {left}")
    for c, rs in used.items():
        for r in rs:
            whole[r, c] += 1
    return whole


def _quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """The whole quotas of one plan from its cells (plan_id, table_name, class_key, stratum, n, available, requested)."""
    cells = {}
    for x in pdf.itertuples():
        if x.available:
            cells[x.class_key, int(x.stratum)] = Fraction(min(int(x.requested), int(x.available)) * int(x.n), int(x.available))
    whole = round_table(cells)
    return pdf.assign(quota=[whole.get((x.class_key, int(x.stratum)), 0) for x in pdf.itertuples()])[["plan_id", "table_name", "class_key", "stratum", "quota"]]


def class_key(c: str):
    """A class as it is compared: without surrounding white space and letter case."""
    return F.lower(F.regexp_replace(F.col(c), r"^(?U)\s+|(?U)\s+$", ""))


def records(df: DataFrame, table_name: str, key: str, label: str, stratum: str) -> DataFrame:
    """One row (table_name, key, class_key, stratum) for each record; of deliveries that differ the smallest counts.

    Rows without a key cannot be told apart and are left out; a null stratum is a stratum of its own.
    """
    cols = df.where(F.col(key).isNotNull()).select(F.lit(table_name).alias("table_name"), F.col(key).cast("long").alias("key"), class_key(label).alias("class_key"), F.pmod(F.xxhash64(F.col(stratum).cast("string")), F.lit(STRATA)).cast("int").alias("stratum"))
    return cols.groupBy("table_name", "key").agg(F.min(F.struct("class_key", "stratum")).alias("r")).select("table_name", "key", "r.class_key", "r.stratum")


def requests(recs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells (table_name, class_key, stratum, n) of all planned classes, and each plan's class with the rows requested and available."""
    plans = targets.withColumn("class_key", class_key("class"))
    known = plans.select("table_name", "class_key").distinct()
    cells = lookup(recs.groupBy("table_name", "class_key", "stratum").agg(F.count(F.lit(1)).alias("n")), known, ["table_name", "class_key"], "left_semi")
    have = cells.groupBy("table_name", "class_key").agg(F.sum("n").alias("available"))
    total = cells.groupBy("table_name").agg(F.sum("n").alias("T"))
    want = plans.join(total, "table_name", "left").join(have, ["table_name", "class_key"], "left").fillna(0, ["T", "available"])
    return cells, want.withColumn("requested", F.greatest(F.col("min_rows").cast("long"), F.expr("(T * sample_pct * target_pct) div 10000")))


def draw(recs: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """The sample: plan_id, table_name, key, class_key, exactly ``min(requested, available)`` records of each plan's class.

    ``targets`` has plan_id, table_name, sample_pct, class, target_pct, min_rows. A class is compared by ``class_key``;
    records of a class in no plan of their table, null or blank ones included, take no part. Targets for an empty table or
    an absent class draw nothing. The same seed draws the same rows, however the rows are partitioned.

    Scale: records are counted by cell with partial aggregation; the quota table has at most STRATA cells for each plan's
    class and is rounded by one task per plan. A cell's quota is taken exactly without sorting the cell: counts of
    KEY_RANGES ranges of the random key give the range in which the quota ends; smaller ranges are taken whole and only
    that range is ranked, so a class with a third of all rows needs no large sort.
    """
    return _draw(written(recs), targets, seed)


def _draw(recs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    cells, want = requests(recs, targets)
    table = want.select("plan_id", "table_name", "class_key", "requested", "available").join(cells, ["table_name", "class_key"])
    quotas = table.groupBy("plan_id").applyInPandas(_quotas, "plan_id int, table_name string, class_key string, stratum int, quota long").where("quota > 0")
    on = ["table_name", "class_key", "stratum"]
    # One row per cell with the quotas of all plans, so that the join stays unique on its key.
    per_cell = written(quotas.groupBy(*on).agg(F.collect_list(F.struct("plan_id", "quota")).alias("q")))
    keyed = lookup(recs, per_cell, on, "inner").select(*on, "key", F.explode("q").alias("q")).select("q.plan_id", *on, "key", "q.quota")
    keyed = keyed.withColumn("rnd", F.xxhash64(F.lit(seed), "plan_id", "key")).withColumn("part", F.shiftrightunsigned("rnd", 52).cast("int"))
    cell = ["plan_id", *on]
    counts = keyed.groupBy(*cell, "part", "quota").agg(F.count(F.lit(1)).alias("m"))
    upto = F.expr("sum(m) OVER (PARTITION BY plan_id, table_name, class_key, stratum ORDER BY part)")
    edge = written(counts.withColumn("upto", upto).where("upto >= quota AND upto - m < quota").select(*cell, F.col("part").alias("edge"), (F.col("quota") - F.col("upto") + F.col("m")).alias("rest")))
    marked = lookup(keyed, edge, cell, "inner")
    inside = marked.where("part < edge").select("plan_id", "table_name", "key", "class_key")
    rank = F.expr("row_number() OVER (PARTITION BY plan_id, table_name, class_key, stratum ORDER BY rnd, key)")
    border = marked.where("part = edge").withColumn("rank", rank).where("rank <= rest").select("plan_id", "table_name", "key", "class_key")
    return inside.unionByName(border)


def report(recs: DataFrame, targets: DataFrame, drawn: DataFrame | None = None, seed: int = 11) -> DataFrame:
    """One row for each plan's class: rows requested, available and drawn, ``met`` false where fewer were drawn than requested.

    ``drawn`` are the rows counted in the sample itself. The records are read once, for the sample and the requests.
    """
    recs = written(recs)
    got = (_draw(recs, targets, seed) if drawn is None else drawn).groupBy("plan_id", "class_key").agg(F.count(F.lit(1)).alias("drawn"))
    want = requests(recs, targets)[1]
    out = want.join(got, ["plan_id", "class_key"], "left").fillna(0, ["drawn"])
    return out.select("plan_id", "table_name", F.col("class"), "target_pct", "min_rows", "requested", "available", "drawn", (F.col("drawn") >= F.col("requested")).alias("met"))


def margins(recs: DataFrame, targets: DataFrame, drawn: DataFrame) -> DataFrame:
    """plan_id, class and stratum sums of a sample against what was asked: ``classes`` (every class has the rows it can give) and ``strata`` (every
    stratum has its share of the plan's rows, rounded down or up)."""
    recs = written(recs)
    cells, want = requests(recs, targets)
    share = want.join(cells, ["table_name", "class_key"]).select("plan_id", "class_key", "stratum", (F.least("requested", "available") * F.col("n") / F.col("available")).alias("share"))
    strata = drawn.join(recs.select("table_name", "key", "stratum"), ["table_name", "key"]).groupBy("plan_id", "stratum").agg(F.count(F.lit(1)).alias("got"))
    columns = share.groupBy("plan_id", "stratum").agg(F.sum("share").alias("share")).join(strata, ["plan_id", "stratum"], "left").fillna(0, ["got"])
    strata_ok = columns.groupBy("plan_id").agg(F.min(F.abs(F.col("got") - F.col("share")) < 1 + 1e-6).alias("strata"))
    got = drawn.groupBy("plan_id", "class_key").agg(F.count(F.lit(1)).alias("got"), F.countDistinct("key").alias("keys"))
    classes = want.join(got, ["plan_id", "class_key"], "left").fillna(0, ["got", "keys"]).groupBy("plan_id").agg(F.min((F.col("got") == F.least("requested", "available")) & (F.col("got") == F.col("keys"))).alias("classes"))
    return classes.join(strata_ok, "plan_id", "left").select("plan_id", "classes", F.coalesce("strata", F.lit(True)).alias("strata"))
