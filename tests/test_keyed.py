"""State by key: streams agree with one pass over the same rows, and nothing is left of what is quiet."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import keyed, watch

T0 = datetime(2024, 1, 1)
AT = lambda m: T0 + timedelta(minutes=m)


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a", "x", AT(0)), ("a", "y", AT(3)), ("a", "x", AT(3)), ("a", "x", AT(8)), ("b", None, AT(1)), ("b", "z", AT(90)), ("a", "p1", AT(91)), ("a", "p2", AT(92)), ("a", "p3", AT(93)), ("a", "p4", AT(94))]
    return spark.createDataFrame(rows, "root string, path string, ts timestamp")


def test_bursts_of_a_stream_are_those_of_a_table(events, tmp_path):
    want = keyed.debounced(events, timedelta(minutes=5), 3)
    assert {(r.root, r.n_events, r.n_paths, r.overflow) for r in want.collect()} == {("a", 3, 2, False), ("a", 1, 1, False), ("b", 1, 0, False), ("b", 1, 1, False), ("a", 4, 3, True)}
    for files in (1, 3):
        got = keyed.replayed(events, lambda s: keyed.debounced(s, timedelta(minutes=5), 3), keyed.BURSTS, f"file://{tmp_path}/{files}", files)
        assert _rows(got) == _rows(want)


def test_own_writes_are_suppressed_for_their_time(spark, tmp_path):
    rows = [("p", None, AT(0), True), ("p", 1, AT(0), False), ("p", 2, AT(9), False), ("p", 3, AT(10), False), ("q", 4, AT(5), False), ("p", None, AT(20), True), ("p", 5, AT(19), False), ("p", 6, AT(29), False), ("p", 7, AT(31), False)]
    df = spark.createDataFrame(rows, "path string, id long, ts timestamp, own boolean")
    got = keyed.replayed(df, lambda s: keyed.unsuppressed(s, timedelta(minutes=10)), keyed.PASSED, f"file://{tmp_path}/s")
    assert {r.id for r in got.collect()} == {3, 4, 5, 7}
    batch = watch.suppress(df.where("NOT own").select("id", "path", "ts"), df.where("own").select("path", F.col("ts").alias("written")), 600)
    assert _rows(got.select("id")) == _rows(batch.select("id"))


def test_heads_are_remembered_over_batches(spark, tmp_path):
    rows = [("main", AT(0), "c1"), ("main", AT(1), "c1"), ("dev", AT(1), "c1"), ("main", AT(2), "c2"), ("main", AT(3), "c2"), ("main", AT(4), "c1"), ("dev", AT(5), None), ("dev", AT(6), None)]
    df = spark.createDataFrame(rows, "branch string, ts timestamp, head string")
    got = keyed.replayed(df, keyed.moved_heads, keyed.MOVES, f"file://{tmp_path}/h")
    assert {(r.branch, r.ts, r.head) for r in got.collect()} == {("main", AT(0), "c1"), ("dev", AT(1), "c1"), ("main", AT(2), "c2"), ("main", AT(4), "c1"), ("dev", AT(5), None)}


def test_state_is_let_go(spark, events, tmp_path):
    """After a year without events only the row that moved the watermark has state."""
    for k, v in keyed.STATE_STORE.items():
        spark.conf.set(k, v)
    (events.where(F.col("ts") < AT(60))).coalesce(1).write.parquet(f"{tmp_path}/in/part=0")
    spark.createDataFrame([("late", "x", AT(600_000))], events.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part=1")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = keyed.debounced(stream, timedelta(minutes=5), 3).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    for k in keyed.STATE_STORE:
        spark.conf.unset(k)
    assert max(kept) > kept[-1] and kept[-1] <= 4
