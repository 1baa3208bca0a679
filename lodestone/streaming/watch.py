"""Watching for changes: debounce, overflow, suppression, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, gap: str = "5 minutes", by: tuple[str, ...] = ()) -> DataFrame:
    """start, end, n of runs of events (ts) with less than ``gap`` between neighbours; the same for batch and, behind a watermark, for streams.

    A stream needs a column in ``by``, such as the root that is watched.  In batch, without one, days are cut
    into runs side by side, and only the first and the last run of each day are then joined over midnight.
    """
    if by or events.isStreaming:
        s = events.groupBy(F.session_window("ts", gap).alias("w"), *by).agg(F.count("*").alias("n"))
        return s.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    day = events.select("ts", F.to_date("ts").alias("day")).groupBy(F.session_window("ts", gap).alias("w"), "day").agg(F.count("*").alias("n")).select("day", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    own = Window.partitionBy("day")
    runs = day.select("*", ((F.col("start") == F.min("start").over(own)) | (F.col("start") == F.max("start").over(own))).alias("edge"))
    order = Window.orderBy("start")  # two rows a day
    edges = runs.where("edge").select("start", "end", "n", F.coalesce(F.col("start") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int").alias("new"))
    joined = edges.select("*", F.sum("new").over(order).alias("run")).groupBy("run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return runs.where("NOT edge").select("start", "end", "n").unionByName(joined.select("start", "end", "n"))


def pending(events: DataFrame, window: str = "1 day", cap: int = 50, most: int = 1000) -> DataFrame:
    """start, n_paths, overflow, n_events of the distinct paths in each window; more than ``cap`` ask for a full pass."""
    w = events.groupBy(F.window("ts", window).alias("w")).agg(F.count_distinct("path").alias("n"), F.count("*").alias("e"))
    return w.select(F.col("w.start").alias("start"), F.least("n", F.lit(cap)).alias("n_paths"), (F.col("n") > cap).alias("overflow"), F.least("e", F.lit(most)).alias("n_events"))


def pending_stream(events: DataFrame, window: str = "1 day", cap: int = 50, late: str = "1 hour") -> DataFrame:
    """``pending`` over a stream; it keeps a set of paths for each open window, ``keyed.debounced`` no more than a cap of them."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(F.size(F.collect_set("path")).alias("n"), F.count("*").alias("e"))
    return w.select(F.col("w.start").alias("start"), F.least("n", F.lit(cap)).alias("n_paths"), (F.col("n") > cap).alias("overflow"), F.col("e").alias("n_events"))


def temp_base(path):
    """The path that an editor's temporary sibling stands for: x of x.tmp, x~, .x.swp, .#x and x.tmp.123."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(\.tmp(\.[0-9A-Za-z]+)?|~)$", ""), r"^\.#", ""), r"^\.(.+)\.sw[a-z]$", "$1")
    return F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), plain)


def suppress(events: DataFrame, own: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    """Events (id, path, ts) without those on a path that we wrote (path, written) within ``ttl_seconds`` before."""
    at, ttl = lambda c: F.unix_micros(F.col(c).cast("timestamp")), ttl_seconds * 1_000_000
    bucket = lambda c: F.floor(at(c) / ttl)
    w = own.select("path", "written", F.explode(F.array(bucket("written"), bucket("written") + 1)).alias("b"))
    e = events.withColumn("b", bucket("ts"))
    near = (F.col("ts") >= F.col("written")) & (at("ts") - at("written") < ttl)
    hit = e.join(w, ["path", "b"]).where(near).select("id").distinct()
    return events.join(hit, "id", "left_anti")


def head_moves(heads: DataFrame) -> DataFrame:
    """The observations (branch, ts, head) at which a branch's head isn't what it was."""
    before = F.lag("head").over(Window.partitionBy("branch").orderBy("ts"))
    return heads.select("*", before.alias("b")).where(F.col("b").isNull() | (F.col("b") != F.col("head"))).select("branch", "ts", "head")


def keep_newest_outcome(attempts: DataFrame) -> DataFrame:
    """The recorded attempt (key, started, finished, completed): a failure that began before a newer completion isn't recorded."""
    done = attempts.where("completed").groupBy("key").agg(F.max("finished").alias("last"))
    a = attempts.join(done, "key", "left").where(F.col("completed") | F.col("last").isNull() | (F.col("started") >= F.col("last")))
    return a.groupBy("key").agg(F.max(F.struct("finished", "completed")).alias("b")).select("key", F.col("b.finished").alias("finished"), F.col("b.completed").alias("completed"))


def relevant(events: DataFrame, ignored: tuple[str, ...] = (".git", "target", "node_modules")) -> DataFrame:
    """Events outside ignored folders."""
    return events.where(~F.col("path").rlike("(^|/)(" + "|".join(x.replace(".", r"\.") for x in ignored) + ")(/|$)"))


class RevisionCache:
    """Reads cached for one revision; a read at another one builds anew and lets the old one go."""

    def __init__(self, build) -> None:
        self.build, self.revision, self.rows = build, None, None

    def at(self, revision) -> DataFrame:
        if self.rows is None or revision != self.revision:
            if self.rows is not None:
                self.rows.unpersist()
            self.revision, self.rows = revision, self.build().cache()
        return self.rows


def watch_loop(stream: DataFrame, full_pass, apply, checkpoint: str, interval: str = "1 second", cap: int = 1000, after=None):
    """A full pass, then a query that applies each micro-batch of events (path); a batch of more than ``cap`` distinct paths asks for a full pass instead.

    ``after`` runs when a batch is done, for cheap repairs; an empty batch keeps the watch alive and does nothing.
    """
    full_pass()

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()  # counted and applied, read once
        try:
            paths = batch.select("path").distinct().limit(cap + 1).count()
            if not paths:
                return
            full_pass() if paths > cap else apply(relevant(batch), number)
            if after is not None:
                after(number)
        finally:
            batch.unpersist()

    return run_sync(stream, step, checkpoint, interval)


def run_sync(stream: DataFrame, apply, checkpoint: str, interval: str = "1 second"):
    """Start a query that hands each micro-batch of events to ``apply(batch, id)``."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
