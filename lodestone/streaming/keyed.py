"""Watching with state by key: debounce with a bounded set of paths, suppression of own writes, heads of branches.

Each processor keeps one key's state in the state store, so it survives a lost executor with the query's checkpoint, and
each lets go of it by a timer in event time: what a root, a path or a branch leaves behind is bounded once it is quiet.
Streams need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the worker that plans a stateful query may not find this package

#: Rows of a file of a replay.
ROWS_A_FILE = 1_000_000

BURSTS = "root string, start timestamp, end timestamp, n_events long, n_paths long, overflow boolean"
PASSED = "id long, path string, ts timestamp"
MOVES = "branch string, ts timestamp, head string"


def _micros(t: timedelta) -> int:
    return t // timedelta(microseconds=1)


class _Keyed(StatefulProcessor):
    """State of one value and one timer a key."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.STATE)

    def wait_until(self, when: int) -> None:
        """Have one timer only, at ``when`` in microseconds, rounded up to a millisecond."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-when // 1000))

    def let_go(self, when: int, timerValues) -> None:
        """Forget a key of which nothing was seen until ``when``, or wait on: so a timer is set once and isn't moved with each batch."""
        if -(-when // 1000) <= timerValues.getCurrentWatermarkInMs():
            self.state.clear()
        else:
            self.handle.registerTimer(-(-when // 1000))

    def close(self) -> None:
        pass


class _Debounce(_Keyed):
    """A burst ends when a root has been quiet for the gap; paths are told apart up to the cap."""

    STATE = "start long, last long, n long"

    def __init__(self, gap: timedelta, cap: int) -> None:
        self.gap, self.cap = _micros(gap), cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def _burst(self, root: str, start: int, last: int, n: int) -> Row:
        n_paths = sum(1 for _ in self.paths.keys())  # at most one more than the cap
        self.paths.clear()
        return Row(root=root, start=start, end=last + self.gap, n_events=n, n_paths=min(n_paths, self.cap), overflow=n_paths > self.cap)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.state.get() if self.state.exists() else None
        start, last, n = now if now else (None, None, 0)
        held = sum(1 for _ in self.paths.keys())
        for r in sorted(rows, key=lambda r: r.at):  # those of one key in one micro-batch
            if last is not None and r.at >= last + self.gap:
                yield self._burst(key[0], start, last, n)
                start, last, n, held = None, None, 0, 0
            start, last, n = r.at if start is None else start, r.at if last is None else max(last, r.at), n + 1
            if held <= self.cap and r.path is not None and not self.paths.containsKey((r.path,)):
                self.paths.updateValue((r.path,), (True,))
                held += 1
        self.state.update((start, last, n))
        self.wait_until(last + self.gap)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            yield self._burst(key[0], *self.state.get())
            self.state.clear()


class _Suppress(_Keyed):
    """A change passes unless we wrote its path less than the time to live before."""

    STATE = "written long"

    def __init__(self, ttl: timedelta) -> None:
        self.ttl = _micros(ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        before = written = kept[0] if kept else None
        for r in sorted(rows, key=lambda r: (r.at, not r.own)):
            if r.own:
                written = r.at if written is None else max(written, r.at)
            elif written is None or not 0 <= r.at - written < self.ttl:
                yield Row(id=r.id, path=key[0], ts=r.at)
        if written != before:
            self.state.update((written,))
            if before is None:
                self.handle.registerTimer(-(-(written + self.ttl) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept:
            self.let_go(kept[0] + self.ttl, timerValues)
        return iter(())


class _Heads(_Keyed):
    """A branch's head is passed on when it isn't what it was; a branch not seen for long is forgotten."""

    STATE = "head string, last long"

    def __init__(self, forget: timedelta) -> None:
        self.forget = _micros(forget)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.state.get()
        head, last = kept if kept else (None, None)
        for r in sorted(rows, key=lambda r: r.at):
            if r.head != head:
                yield Row(branch=key[0], ts=r.at, head=r.head)
            head, last = r.head, r.at
        self.state.update((head, last))
        if not kept:
            self.handle.registerTimer(-(-(last + self.forget) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        kept = self.state.get()
        if kept:
            self.let_go(kept[1] + self.forget, timerValues)
        return iter(())


def _run(stream: DataFrame, key: str, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """Processors count in microseconds, which no time zone touches."""
    ts = F.col("ts").cast("timestamp")
    out = stream.withColumn("ts", ts).withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy(key).transformWithState(statefulProcessor=processor, outputStructType=schema.replace("timestamp", "long"), outputMode="Append", timeMode="EventTime")
    times = {c.split()[0] for c in schema.split(", ") if c.endswith("timestamp")}
    return out.select(*[F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in out.columns])


def debounced(events: DataFrame, gap: timedelta = timedelta(minutes=5), cap: int = 1000, late: str = "0 seconds") -> DataFrame:
    """BURSTS of events (root, path, ts): runs of a root with less than ``gap`` between neighbours, and how many distinct paths they touch.

    More than ``cap`` paths are an overflow, which asks for a full pass.  A stream keeps ``cap`` + 1 paths of a root at most, and nothing
    of a root that is quiet; a burst comes out when the next one begins or the watermark passes its end.  A null path is an
    event without a path; a null root is a root.
    """
    if events.isStreaming:
        return _run(events, "root", late, _Debounce(gap, cap), BURSTS)
    seconds = f"{int(gap.total_seconds())} seconds"
    order = Window.partitionBy("root").orderBy("ts")
    ts = F.col("ts").cast("timestamp")
    new = F.coalesce(ts >= F.lag(ts).over(order) + F.expr(f"INTERVAL {seconds}"), F.lit(True)).cast("int")
    runs = events.select("root", "path", ts.alias("ts"), new.alias("new")).select("*", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("run"))
    paths = runs.groupBy("root", "run", "path").agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    b = paths.groupBy("root", "run").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n_events"), F.count("path").alias("n_paths"))
    return b.select("root", "start", (F.col("last") + F.expr(f"INTERVAL {seconds}")).alias("end"), "n_events", F.least("n_paths", F.lit(cap)).alias("n_paths"), (F.col("n_paths") > cap).alias("overflow"))


def unsuppressed(rows: DataFrame, ttl: timedelta = timedelta(minutes=10), late: str = "0 seconds") -> DataFrame:
    """PASSED of changes and own writes in one stream (id, path, ts, own): changes of no path that we wrote less than ``ttl`` before."""
    return _run(rows, "path", late, _Suppress(ttl), PASSED)


def moved_heads(heads: DataFrame, forget: timedelta = timedelta(days=30), late: str = "0 seconds") -> DataFrame:
    """MOVES of observations (branch, ts, head) of a stream: those at which a branch's head isn't what it was."""
    return _run(heads, "branch", late, _Heads(forget), MOVES)


def replayed(rows: DataFrame, watch, schema: str, where: str, files: int = 3, most: int = 150_000) -> DataFrame:
    """Replay a table with a column ts through ``watch`` (a stream to a stream) in micro-batches in order of time, and read what came out.

    There are ``files`` of them, or as many as it takes for about ``most`` rows of one key each, as a processor sorts the rows of one key and batch; a key
    costs much with each batch it is in.  A batch comes in files of about ROWS_A_FILE rows, each of a time of its own.
    A last row a year later lets the watermark pass everything; what it causes itself has a null key and is left out.
    """
    spark, key = rows.sparkSession, rows.columns[0]
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    n = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.sum("n").alias("all"), F.max("n").alias("key")).first()
    pieces = max(files, -(-(n["all"] or 0) // ROWS_A_FILE), -(-(n["key"] or 0) // most))
    pieces = -(-pieces // files) * files
    bounds = rows.select(F.percentile_approx(F.unix_micros("ts"), [k / pieces for k in range(1, pieces)]).alias("at"), F.max("ts").alias("last")).first()
    at = sorted(bounds["at"] or [])
    part = sum((F.when(F.unix_micros("ts") >= x, 1).otherwise(0) for x in at), F.lit(0))
    rows.withColumn("part", part).repartition(pieces, "part").write.partitionBy("part").parquet(f"{where}/dealt")
    dealt = spark.read.schema(rows.withColumn("part", part).schema).parquet(f"{where}/dealt")
    hot = dealt.groupBy(key, "part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    each = max(1, min(pieces // files, most // hot))  # files of a batch
    end = spark.range(1).select(*[(F.lit(bounds["last"]) + F.expr("INTERVAL 366 days")).alias(c) if c == "ts" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    parts = [dealt.where(F.col("part") == k).drop("part") for k in range(pieces)] + [end]
    with ThreadPoolExecutor(8) as pool:  # a batch's files are written at the same time, batches one after the other, as the stream takes files by their time
        for first in range(0, len(parts), each):
            list(pool.map(lambda k: parts[k].coalesce(1).write.parquet(f"{where}/in/part={k}"), range(first, min(first + each, len(parts)))))
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", "true").parquet(f"{where}/in")
        watch(stream).writeStream.format("parquet").option("checkpointLocation", f"{where}/cp").option("path", f"{where}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(schema).parquet(f"{where}/out").where(F.col(key).isNotNull())
