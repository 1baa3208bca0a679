"""Advisory annotations: links and notes folded from events, their freshness, and what to report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .budget import tier

#: The state that each event of a link leads to.
STATES = {"generated": "active", "regenerated": "active", "pending": "pending_promotion", "promoted": "promoted", "rejected": "rejected", "rolled_back": "active"}


def fold_links(events: DataFrame) -> DataFrame:
    """link, state, n_events: the state after the last of a link's events (link, seq, event)."""
    state = F.coalesce(*[F.when(F.col("event") == e, s) for e, s in STATES.items()])
    return events.groupBy("link").agg(F.max(F.struct("seq", state.alias("s"))).alias("last"), F.count("*").alias("n_events")).select("link", F.col("last.s").alias("state"), "n_events")


def recover_pending(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Links (link, src, dst, state) left pending by a crash: promoted if the edge was written, else active again."""
    e = edges.select("src", "dst", F.lit(True).alias("written")).distinct()
    j = links.join(e, ["src", "dst"], "left")
    return j.select("link", F.when(F.col("state") != "pending_promotion", F.col("state")).when(F.col("written"), "promoted").otherwise("active").alias("state"))


def state_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(F.col(column).alias("state")).agg(F.count("*").alias("n"))


def freshness(stored: Column, current: Column, valid: Column) -> Column:
    """invalid, source_deleted, fresh or stale, in this order."""
    return F.when(~valid, "invalid").when(current.isNull(), "source_deleted").when(stored == current, "fresh").otherwise("stale")


def commentary_freshness(stored: Column, current: Column) -> Column:
    """invalid without a stored hash or a source, fresh if they are equal, else stale."""
    return F.when(F.coalesce(stored, F.lit("")) == "", "invalid").when(current.isNull(), "invalid").when(stored == current, "fresh").otherwise("stale")


def link_freshness(links: DataFrame, current: DataFrame) -> DataFrame:
    """Links (link, path, hash, valid) against current hashes (path, now)."""
    return links.join(current, "path", "left").select("link", freshness(F.col("hash"), F.col("now"), F.col("valid")).alias("freshness"))


def findings(links: DataFrame, limit: int = 50) -> DataFrame:
    """Links (link, score, generated, freshness) that need a look: not in the high tier, or without their source."""
    f = links.select("link", "score", "generated", "freshness", tier(F.col("score")).alias("tier"))
    return f.where((F.col("tier") != "high") | (F.col("freshness") == "source_deleted")).orderBy(F.desc("score"), F.desc("generated"), "link").limit(limit)


def candidates(links: DataFrame, tier_name: str | None = None, limit: int = 50) -> DataFrame:
    """Active links (link, state, score, generated), best first."""
    c = links.where(F.col("state") == "active").withColumn("tier", tier(F.col("score")))
    return (c.where(F.col("tier") == tier_name) if tier_name else c).orderBy(F.desc("score"), F.desc("generated"), "link").limit(limit)


def note_drift(anchors: DataFrame, current: DataFrame) -> DataFrame:
    """note, drifted, missing: whether any anchor (note, path, hash) changed or is gone."""
    j = anchors.join(current, "path", "left")
    return j.groupBy("note").agg(F.bool_or(F.col("now").isNotNull() & (F.col("now") != F.col("hash"))).alias("drifted"), F.bool_or(F.col("now").isNull()).alias("missing"))


def visible_notes(notes: DataFrame, limit: int = 50) -> DataFrame:
    """Notes (note, status, updated) but for those put aside, newest first."""
    return notes.where(~F.col("status").isin("forgotten", "superseded", "invalid")).orderBy(F.desc("updated"), "note").limit(limit)


def supersede(notes: DataFrame) -> DataFrame:
    """Notes (note, thread, seq): the last of a thread is active, the others are superseded by the next."""
    from pyspark.sql import Window

    nxt = F.lead("note").over(Window.partitionBy("thread").orderBy("seq"))
    return notes.select("note", "thread", nxt.alias("by")).select("note", F.when(F.col("by").isNull(), "active").otherwise("superseded").alias("status"), "by")


def lesson_search(lessons: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Lessons (id, claim, fresh, verified, updated): 5 for each term held, 2 if fresh, 1 if verified; those without a term go."""
    held = sum([F.when(F.lower("claim").contains(t.lower()), 5).otherwise(0) for t in terms], F.lit(0))
    s = lessons.select("id", "updated", held.alias("held"), (held + F.when(F.col("fresh"), 2).otherwise(0) + F.when(F.col("verified"), 1).otherwise(0)).alias("score"))
    return s.where("held > 0").select("id", "score", "updated").orderBy(F.desc("score"), F.desc("updated"), "id").limit(limit)


def recent_activity(kinds: list[tuple[str, DataFrame]], per_kind: int = 50, limit: int = 200) -> DataFrame:
    """The newest entries (id, ts) of each kind, then of all, newest first."""
    parts = [df.orderBy(F.desc("ts"), "id").limit(per_kind).select("id", "ts", F.lit(k).alias("kind")) for k, df in kinds]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("ts"), "kind", "id").limit(min(limit, 200))


def handoffs(hot: DataFrame, limit: int = 20) -> DataFrame:
    """Hot paths (path, touches) as work to hand on: 20 touches are high, 10 medium, 5 low priority."""
    p = hot.select("path", "touches", F.when(F.col("touches") >= 20, 3).when(F.col("touches") >= 10, 2).when(F.col("touches") >= 5, 1).alias("priority")).where("priority IS NOT NULL")
    return p.orderBy(F.desc("priority"), F.desc("touches"), "path").limit(limit)


def all_handoffs(structural: DataFrame, annotated: DataFrame, limit: int = 20) -> DataFrame:
    """item, priority, source of work to hand on (item, priority): by priority, and of equals what the graph shows before what annotations say."""
    both = structural.select("item", "priority", F.lit("structural").alias("source"), F.lit(0).alias("rank")).unionByName(annotated.select("item", "priority", F.lit("overlay").alias("source"), F.lit(1).alias("rank")))
    return both.orderBy(F.desc("priority"), "rank", "item").limit(limit).select("item", "priority", "source")


def concept_links(concepts: DataFrame, symbols: DataFrame, min_length: int = 4) -> DataFrame:
    """(concept, symbol) where a word of a concept's text (concept, body) is a symbol's short name (symbol, qualified_name)."""
    words = concepts.select("concept", F.explode(F.array_distinct(F.split("body", "[^A-Za-z0-9_]+"))).alias("word")).where(F.length("word") >= min_length)
    tails = symbols.select("symbol", text.short_name(F.col("qualified_name")).alias("word")).where(F.length("word") >= min_length)
    return words.join(tails, "word").select("concept", "symbol").distinct()


def commentary_range(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def repair_report(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """surface, severity, n: one row of each check (surface, severity, findings), also when it found nothing."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(s).alias("surface"), F.when(F.col("n") > 0, F.lit(v)).otherwise("clean").alias("severity"), "n") for s, v, df in checks])


def metrics(events: DataFrame) -> DataFrame:
    """tool, n, total, mean, worst of events (tool, value); a mean over nothing is 0."""
    return events.groupBy("tool").agg(F.count("value").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.max("value").alias("worst"))


def prometheus(metrics_: DataFrame, prefix: str = "lodestone") -> DataFrame:
    """The counters as text lines of the exposition format."""
    line = lambda name, col: F.format_string(f'{prefix}_{name}{{tool="%s"}} %s', F.col("tool"), F.col(col).cast("string"))
    return metrics_.select(F.explode(F.array(line("events_total", "n"), line("value_sum", "total"))).alias("line"))
