"""Structured Streaming over events: windowed counts, sessions, and time since the user's last event."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Times in a stream must be timestamps with a zone.
LATE = "1 hour"


def stream(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """A stream of the parquet files of a folder (or of one file), ``per_trigger`` at a time."""
    r = spark.readStream.schema(schema)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, name = path.rsplit("/", 1)
        r = r.option("pathGlobFilter", name)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """start, event_type, n, total of tumbling windows; events later than ``late`` behind the newest are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, end, n of runs of a user's events with less than ``gap`` between them; ``end`` is the gap after the last."""
    s = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deltas(events: DataFrame, late: str = LATE, keep_days: int = 30) -> DataFrame:
    """user_id, event_id, delta_us since the user's last event, kept in state across batches; 0 for the first.

    A user's state is dropped once the watermark is ``keep_days`` past the last event, so that state grows with the users of that time and not for ever; the next event is a
    first one again. Events later than ``late`` behind the newest are dropped. An event that comes after a newer one of its user, but not so late, gets null, as
    what it should follow is no longer known. A user's events of one batch are sorted by one task.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        f = pd.concat(list(frames)).sort_values(["us", "event_id"])
        us = f["us"].to_numpy()
        before = pd.Series(us).shift(1)
        if last is not None:
            before.iloc[0] = last
            before = before.where(us >= last).where(before >= last, last).where(us >= last)
        delta = (pd.Series(us) - before).astype("Int64")
        if last is None:
            delta.iloc[0] = 0
        newest = int(us[-1]) if last is None else max(last, int(us[-1]))
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest // 1000 + keep_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(f), "event_id": f["event_id"].to_numpy(), "delta_us": delta.to_numpy()})

    timed = events.where("ts IS NOT NULL").withWatermark("ts", late).select("user_id", "event_id", "ts", F.unix_micros("ts").alias("us"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, event_id bigint, delta_us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(result: DataFrame, target: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns the written table; late windows still open stay unwritten in append mode."""
    if mode == "append":
        q = result.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = result.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(target)).start()
    q.awaitTermination()
    if q.exception():
        raise RuntimeError(str(q.exception()))
    return result.sparkSession.read.schema(result.schema).parquet(target)
