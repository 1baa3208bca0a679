"""Upkeep of the graph and its annotations: audit rows, refreshes, scoped passes, counters, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .budget import tier
from .overlay import STATES, freshness

#: What each check of a repair report may lead to.
SURFACES = {
    "writer_lock": "blocked", "store_maintenance": "actionable", "structural_refresh": "actionable", "declared_links": "actionable", "commentary_overlay": "actionable", "agent_notes": "report_only",
    "export_surface": "actionable", "edge_drift": "report_only", "retired_observations": "actionable", "legacy_installs": "report_only", "proposed_links": "report_only", "stale_rationale": "report_only",
}


def audited(events: DataFrame) -> DataFrame:
    """link, seq, event, before, after: a row of audit for each event (link, seq, event), with the state it left and the one it led to."""
    state = F.coalesce(*[F.when(F.col("event") == e, s) for e, s in STATES.items()])
    w = Window.partitionBy("link").orderBy("seq")
    return events.select("link", "seq", "event", state.alias("after")).select("link", "seq", "event", F.lag("after").over(w).alias("before"), "after")


def upsert_candidates(links: DataFrame, generated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (link, state, score) after candidates (link, score) came: new ones and those seen again are active; and the audit (link, event)."""
    j = links.join(generated.select("link", F.col("score").alias("new")), "link", "full")
    after = j.select("link", F.when(F.col("new").isNotNull(), "active").otherwise(F.col("state")).alias("state"), F.coalesce("new", "score").alias("score"))
    return after, j.where("new IS NOT NULL").select("link", F.when(F.col("state").isNull(), "generated").otherwise("regenerated").alias("event"))


def refreshed(links: DataFrame, scores: DataFrame, hashes: DataFrame) -> DataFrame:
    """Links (link, path, hash, score) with new scores (link, score), the tier these give, and the current hash (path, now) where there is one."""
    j = links.join(scores.select("link", F.col("score").alias("new")), "link", "left").join(hashes, "path", "left")
    score = F.coalesce("new", "score")
    return j.select("link", F.coalesce("now", "hash").alias("hash"), score.alias("score"), tier(score).alias("tier"))


def note_states(events: DataFrame) -> DataFrame:
    """note, status of notes after their events (note, seq, event): added, linked, verified, stale, superseded, forgotten.

    Linking leaves the status; what is forgotten or superseded stays so.
    """
    by = lambda e: F.max(F.when(F.col("event") == e, F.col("seq")))
    g = events.groupBy("note").agg(by("forgotten").alias("f"), by("superseded").alias("u"), F.max(F.when(F.col("event").isin("added", "verified", "stale"), F.struct("seq", "event"))).alias("last"))
    return g.select("note", F.when(F.col("f").isNotNull(), "forgotten").when(F.col("u").isNotNull(), "superseded").when(F.col("last.event") == "stale", "stale").when(F.col("last.event") == "verified", "verified").otherwise("active").alias("status"))


def link_drift_scan(links: DataFrame, current: DataFrame) -> DataFrame:
    """freshness, n of links (path, hash, valid) against current hashes (path, now)."""
    j = links.join(current, "path", "left")
    return j.groupBy(freshness(F.col("hash"), F.col("now"), F.col("valid")).alias("freshness")).agg(F.count("*").alias("n"))


def reconcile_counters(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """inserted, updated, retired, unchanged between two snapshots, in one row."""
    j = before.select(key, F.col(content).alias("b"), F.lit(1).alias("was")).join(after.select(key, F.col(content).alias("a"), F.lit(1).alias("is")), key, "full")
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    same = F.col("a").eqNullSafe(F.col("b"))
    return j.agg(F.count_if(F.col("was").isNull()).alias("inserted"), F.count_if(both & ~same).alias("updated"), F.count_if(F.col("is").isNull()).alias("retired"), F.count_if(both & same).alias("unchanged"))


def observed_pass(before: DataFrame, after: DataFrame, key: str, content: str) -> tuple[DataFrame, Observation]:
    """The rows of a pass (key, content, what: inserted, updated, retired or unchanged), and their counters, which come
    with whatever job writes the rows and cost no job of their own."""
    j = before.select(key, F.col(content).alias("b"), F.lit(True).alias("was")).join(after.select(key, F.col(content).alias("a"), F.lit(True).alias("is")), key, "full")
    what = F.when(F.col("was").isNull(), "inserted").when(F.col("is").isNull(), "retired").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("updated")
    rows = j.select(key, F.when(F.col("is").isNull(), F.col("b")).otherwise(F.col("a")).alias(content), what.alias("what"))
    counters = Observation()
    return rows.observe(counters, *[F.count_if(F.col("what") == w).alias(w) for w in ("inserted", "updated", "retired", "unchanged")]), counters


def scoped_recompute(stored: DataFrame, computed: DataFrame, touched: DataFrame, root: str = "root_id") -> DataFrame:
    """``stored`` with the rows of the touched roots replaced by those computed; written by root this rewrites their folders alone."""
    t = touched.select(root).distinct()
    return stored.join(t, root, "left_anti").unionByName(computed.join(t, root, "left_semi"))


def auto_sync(outcomes: DataFrame, checks: list[tuple[str, DataFrame]], blocked: bool = False) -> DataFrame:
    """surface, n of the cheap checks after a pass whose last outcome (finished, completed) was completed; nothing else, or if ``blocked``."""
    last = outcomes.agg(F.max_by("completed", "finished").alias("completed"))
    rows = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("surface"), "n") for s, df in checks])
    return rows.crossJoin(F.broadcast(last)).where(F.col("completed") & ~F.lit(blocked)).select("surface", "n")


def repair_report(checks: dict[str, DataFrame]) -> DataFrame:
    """surface, severity, n for each of SURFACES; one without a check is unsupported, one that finds nothing clean."""
    spark = next(iter(checks.values())).sparkSession
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("surface"), "n") for s, df in checks.items()])
    named = spark.createDataFrame(list(SURFACES.items()), "surface string, severity string")
    return named.join(counts, "surface", "left").select("surface", F.when(F.col("n").isNull(), "unsupported").when(F.col("n") == 0, "clean").otherwise(F.col("severity")).alias("severity"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def retained(audit: DataFrame, cutoff: str) -> DataFrame:
    """Audit rows (event, ts) but for promotions and rejections before ``cutoff``."""
    return audit.where(~F.col("event").isin("promoted", "rejected") | (F.col("ts") >= F.lit(cutoff).cast(audit.schema["ts"].dataType)))


def key_sums(maps: DataFrame, by: str, column: str) -> DataFrame:
    """by, key, total: the key-wise sums of a map column by group."""
    return maps.select(by, F.explode(column).alias("key", "value")).groupBy(by, "key").agg(F.sum("value").alias("total"))


def bench_summary(runs: DataFrame, k: int = 5) -> DataFrame:
    """n_tasks, hits_before, hits_after, improved, matched, regressed of tasks (task, before, after: ranks from 0, null for a miss)."""
    hit = lambda c: F.coalesce(F.col(c) < k, F.lit(False))
    b, a = hit("before"), hit("after")
    return runs.agg(F.count("*").alias("n_tasks"), F.count_if(b).alias("hits_before"), F.count_if(a).alias("hits_after"), F.count_if(~b & a).alias("improved"), F.count_if(b == a).alias("matched"), F.count_if(b & ~a).alias("regressed"))
