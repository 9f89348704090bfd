"""State of streams across batches."""

import time

from tamarisk.streaming import events


def test_deltas_across_batches_and_late_events(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(list(r), "user_id bigint, event_id bigint, s bigint").selectExpr("user_id", "event_id", "timestamp_seconds(s) AS ts").coalesce(1)
    rows((1, 1, 1000), (1, 2, 1010), (2, 3, 1000), (1, 9, None)).write.parquet(src)
    time.sleep(1.1)
    # Event 4 comes after event 2 but is older; 5 follows 2, not 4.
    rows((1, 4, 1005), (1, 5, 1030), (1, 6, 1031), (3, 7, 1000)).write.mode("append").parquet(src)
    stream = events.stream(spark, src, rows((1, 1, 1)).schema, per_trigger=1)
    out = events.run_available(events.deltas(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {r.event_id: r.delta_us for r in out.collect()} == {1: 0, 2: 10_000_000, 3: 0, 4: None, 5: 20_000_000, 6: 1_000_000, 7: 0}
