"""Plan-shaping helpers shared by the operators: checked broadcasts, salted lookups, reliable checkpoints.

Nothing here looks at the data beyond a bounded probe, and every branch returns the same rows:
the size of a table only decides how a join is carried out.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from functools import lru_cache
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a lookup table is broadcast.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
#: Copies of a lookup table (and shares of a hot key) in a salted join.
SALTS = 8


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of every executor, once for each application, so that operators run whatever
    the workers' path is. The archive lies with the driver, which serves it to executors that come later, too."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="tamarisk-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tamarisk_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, files in sorted(os.walk(root)):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("tamarisk", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bytes(df: DataFrame):
    """About the bytes of a row: 16 for each flat value, texts by their length, nested values as JSON."""
    size = F.lit(16 * len(df.columns))
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif f.dataType.typeName() in ("array", "map", "struct"):
            size = size + F.coalesce(F.length(F.to_json(c)), F.lit(0))
    return size


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True iff ``df`` has at most ``max_rows`` rows and about ``max_bytes`` bytes; reads no more than ``max_rows + 1`` rows."""
    n, size = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(df).cast("long")), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table as it is read, dealt by ``key`` over all cores if its files make fewer tasks than there are cores.

    Only for scans: asking a plan with a shuffle for its partitions would run it. Large tables have more tasks and stay as
    they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def salted_lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join of ``big`` with ``small`` that splits every key of ``big`` over ``salts`` tasks.

    ``small`` must be unique on ``on`` and is copied ``salts`` times. The salt comes from a hash of the whole
    row of ``big``, so that a recomputed task repeats it. Keys compare with ``=``: a null key finds nothing.
    """
    salt = "__salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def lookup(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int = SALTS, rows: int | None = None) -> DataFrame:
    """Equi-join with a table unique on ``on`` (or, in an inner join, not): broadcast after a check of its rows and bytes, else salted.

    ``rows``: how many rows ``small`` has, where that is known and its columns are all of fixed width, which spares the check a job.
    """
    small_enough = fits(small, max_rows) if rows is None else rows <= max_rows and rows * 16 * len(small.columns) <= BROADCAST_BYTES
    if small_enough:
        return big.join(F.broadcast(small), list(on), how)
    return salted_lookup(big, small, on, how, salts)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or on a local master a temporary folder.

    Raises ``ValueError`` on a cluster without the setting: a machine-local folder would lose data there.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = os.path.join(tempfile.gettempdir(), f"tamarisk-{os.getuid()}")
    os.makedirs(at, exist_ok=True)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder, removed when the session ends."""
    path = f"{shared_dir(spark)}/tamarisk-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which is removed when the session ends.

    Unlike a checkpoint the table carries no constraints of the plan that made it, so that it can be joined and united with itself.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def block_files(df: DataFrame, key: str, rows: int) -> list[str]:
    """The rows in files of about ``rows`` each in the shared folder, dealt by a hash of ``key``, for tasks that go through them block by block."""
    n = max(1, -(-df.count() // rows))
    return sorted(written(df.repartition(n, F.xxhash64(key))).inputFiles())


@lru_cache(maxsize=2)
def read_block(file: str) -> pa.Table:
    """A file of ``block_files``, in a task; the last ones read are kept by the worker."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(file if "://" in file or ":/" in file else f"file://{file}")
    return pq.read_table(unquote(path), filesystem=system)


PART = "__part"


def ordered_parts(df: DataFrame, *order: str) -> DataFrame:
    """The rows in ranges of an order, with the number of their range in ``__part``, kept in a checkpoint so that it stays theirs.

    Windows over one part at a time, joined by what the parts pass on (a row for each part), replace a window over all rows or
    over a hot group: a group with a third of all rows is cut into as many ranges as it needs.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(PART, F.spark_partition_id())
    return checkpoint(parts)


def with_offsets(parts: DataFrame, **sums: str) -> DataFrame:
    """Adds, for each name, the sum of an expression over all earlier parts (0 for the first)."""
    totals = parts.groupBy(PART).agg(*[F.sum(F.expr(e)).alias(n) for n, e in sums.items()])
    before = totals.select(PART, *[F.coalesce(F.expr(f"sum({n}) OVER (ORDER BY {PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0)).alias(n) for n in sums])
    return parts.join(F.broadcast(before), PART)  # a row for each part, as many as there are shuffle partitions


PREV = "__prev"


def with_previous(df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds ``__prev``, the ``columns`` of the row before in its group as a struct, null for the first of a group.

    Each range looks within itself and at the last row of the range before it, so a hot group is spread over tasks. ``order``
    should tell the rows of a group apart. Null groups are one group.
    """
    parts = ordered_parts(df, group, *order)
    row = [group, *(c for c in order if c != group), *(c for c in columns if c not in order and c != group)]
    last = parts.groupBy(PART).agg(F.max(F.struct(*row)).alias("__l"))
    before = last.select(PART, F.expr(f"lag(__l) OVER (ORDER BY {PART})").alias("__b"))
    keys = ", ".join(f"`{c}`" for c in [group, *order])
    own = F.expr(f"lag(struct({', '.join(f'`{c}`' for c in row)})) OVER (PARTITION BY {PART} ORDER BY {keys})")
    rows = parts.join(F.broadcast(before), PART).withColumn("__p", F.coalesce(own, "__b"))  # a row for each part
    same = F.col("__p").isNotNull() & F.col("__p")[group].eqNullSafe(F.col(group))
    return rows.withColumn(PREV, F.when(same, F.struct(*[F.col("__p")[c].alias(c) for c in columns]))).drop(PART, "__b", "__p")


def first_share(df: DataFrame, order: str, rows: int) -> DataFrame:
    """The first ``rows`` rows in the order of a column, exactly, without gathering them in one task."""
    parts = with_offsets(ordered_parts(df, order), __before="1")
    at = F.col("__before") + F.expr(f"row_number() OVER (PARTITION BY {PART} ORDER BY `{order}`)")
    return parts.withColumn("__at", at).where(F.col("__at") <= rows).drop(PART, "__before", "__at")
