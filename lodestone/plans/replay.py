"""Queries that replay events through streams with state by key, with the SQL of the same answer in one pass."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from ..sources.views import Views
from ..streaming import keyed
from .registry import query


@query("""WITH e AS (SELECT 'root_' || user_id % 7 AS root, event_type || user_id % 5 AS path, ts FROM events), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY root ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (PARTITION BY root ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT root, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 1800000000 AS "end", count(*) AS n_events, least(count(DISTINCT path), 3) AS n_paths, count(DISTINCT path) > 3 AS overflow FROM r GROUP BY root, run""")
def replayed_bursts(v: Views) -> DataFrame:
    rows = v.events.select(F.concat(F.lit("root_"), F.col("user_id") % 7).alias("root"), F.concat("event_type", F.col("user_id") % 5).alias("path"), "ts")
    got = keyed.replayed(rows, lambda s: keyed.debounced(s, timedelta(minutes=30), 3), keyed.BURSTS, scratch.folder(v.spark, "bursts"))
    return got.withColumns({"start": F.unix_micros("start"), "end": F.unix_micros("end")})


@query("""SELECT event_id AS id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events o WHERE o.event_type = 'error' AND o.user_id = e.user_id AND o.ts <= e.ts AND o.ts > e.ts - INTERVAL 6 HOUR)""")
def replayed_suppression(v: Views) -> DataFrame:
    """An error stands for our own write of the user's path; changes within six hours after it don't pass, itself least of all, so it comes as a write only."""
    rows = v.events.select(F.concat(F.lit("user_"), "user_id").alias("path"), F.col("event_id").alias("id"), "ts", F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("own"))
    return keyed.replayed(rows, lambda s: keyed.unsuppressed(s, timedelta(hours=6)), keyed.PASSED, scratch.folder(v.spark, "suppression")).select("id")


@query("""WITH h AS (SELECT 'user_' || user_id AS branch, ts, event_type AS head, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)
SELECT branch, epoch_us(ts) AS ts, head FROM h WHERE before IS DISTINCT FROM head""")
def replayed_heads(v: Views) -> DataFrame:
    rows = v.events.select(F.concat(F.lit("user_"), "user_id").alias("branch"), "ts", F.col("event_type").alias("head"))
    return keyed.replayed(rows, keyed.moved_heads, keyed.MOVES, scratch.folder(v.spark, "heads")).withColumn("ts", F.unix_micros("ts"))
