"""Mining of commit history: touches, owners, co-change."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import tasks_of

#: Changes and pairs that one task groups.
ROWS_A_TASK, PAIRS_A_TASK = 500_000, 500_000


def hotspots(commits: DataFrame, changes: DataFrame, limit: int = 20) -> DataFrame:
    """The paths touched most, with the newest revision; order touches descending, path."""
    t = changes.join(commits, "revision").groupBy("path").agg(F.count("*").alias("touches"), F.max(F.struct("ts", "revision")).alias("last"))
    return t.select("path", "touches", F.col("last.revision").alias("last_revision")).orderBy(F.desc("touches"), "path").limit(limit)


def ownership(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """The author with most touches of each path, the least of equals."""
    each = changes.join(commits, "revision").groupBy("path", "author").agg(F.count("*").alias("n"))
    best = each.groupBy("path").agg(F.sum("n").alias("touches"), F.min(F.struct((-F.col("n")).alias("less"), "author")).alias("b"))
    return best.select("path", F.col("b.author").alias("author"), (-F.col("b.less")).alias("author_touches"), "touches")


def pair_tasks(changes: DataFrame, max_paths: int = 100) -> int:
    """Among how many tasks the pairs of ``changes`` are dealt out."""
    spark = changes.sparkSession
    sizes = changes.select("revision").repartition(tasks_of(spark, changes.count(), ROWS_A_TASK), "revision").groupBy("revision").agg(F.least(F.count("*"), F.lit(max_paths)).alias("n"))
    return tasks_of(spark, sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0, PAIRS_A_TASK)


def cochange_pairs(changes: DataFrame, max_paths: int = 100) -> DataFrame:
    """(left_path, right_path, n): unordered pairs changed together; larger commits tell nothing and are left out, rows of ``changes`` may repeat.

    Pairs form inside the array of one commit, so no self join is needed.  Of a larger commit only as many paths as tell that it is one are kept.
    The number of tasks grows with that of the changes and of the pairs, not what one of them holds.
    """
    dealt = changes.select("revision", "path").repartition(tasks_of(changes.sparkSession, changes.count(), ROWS_A_TASK), "revision")
    first = dealt.select("revision", "path", F.dense_rank().over(Window.partitionBy("revision").orderBy("path")).alias("rank")).where(F.col("rank") <= max_paths + 1)
    c = first.groupBy("revision").agg(F.sort_array(F.collect_set("path")).alias("p")).where(F.size("p").between(2, max_paths))
    pairs = c.select(F.posexplode("p").alias("i", "left_path"), "p").select("left_path", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("right_path"))
    return pairs.repartition(pair_tasks(changes, max_paths), "left_path", "right_path").groupBy("left_path", "right_path").agg(F.count("*").alias("n"))


def cochange_edges(changes: DataFrame, known: DataFrame, min_count: int = 2, top: int = 100) -> DataFrame:
    """Of the ``top`` pairs those seen ``min_count`` times at least whose paths are both ``known`` (path)."""
    p = cochange_pairs(changes).orderBy(F.desc("n"), "left_path", "right_path").limit(top).where(F.col("n") >= min_count)
    for side in ("left_path", "right_path"):
        p = p.join(known.select(F.col("path").alias(side)), side, "left_semi")
    return p.select("left_path", "right_path", "n")


def path_history(commits: DataFrame, changes: DataFrame, path: str) -> DataFrame:
    """Commits of one path, newest first, with its partners in each."""
    own = changes.where(F.col("path") == path).select("revision")
    near = changes.join(own, "revision").groupBy("revision").agg((F.count("*") - 1).alias("partners"))
    return commits.join(near, "revision").select("revision", "author", "ts", "partners")


def path_card(commits: DataFrame, changes: DataFrame, path: str, most: int = 5) -> DataFrame:
    """path, touches, last_revision, owner, partners of one path; partners are the ``most`` changed with it most often."""
    own = changes.where(F.col("path") == path)
    t = own.join(commits, "revision")
    hot = t.groupBy("path").agg(F.count("*").alias("touches"), F.max_by("revision", F.struct("ts", "revision")).alias("last_revision"))
    owner = t.groupBy("path", "author").agg(F.count("*").alias("n")).groupBy("path").agg(F.min_by("author", F.struct(-F.col("n"), "author")).alias("owner"))
    few = changes.join(own.select("revision"), "revision").groupBy("revision").agg(F.count("*").alias("n")).where("n <= 100").select("revision")
    near = changes.join(few, "revision").where(F.col("path") != path).groupBy(F.col("path").alias("other")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "other").limit(most)
    listed = near.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "other"))), lambda x: x["other"]).alias("partners"))
    return hot.join(owner, "path").crossJoin(F.broadcast(listed))


def first_last_revision(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """The oldest and the newest revision of each path."""
    t = changes.join(commits, "revision").groupBy("path").agg(F.min(F.struct("ts", "revision")).alias("a"), F.max(F.struct("ts", "revision")).alias("b"))
    return t.select("path", F.col("a.revision").alias("first_seen"), F.col("b.revision").alias("last_modified"))


def body_changes(observed: DataFrame) -> DataFrame:
    """symbol, first_seen_rev, last_modified_rev, changed_at_rev of (symbol, seq, revision, body).

    last_modified_rev is the newest revision with another body than the current one,
    changed_at_rev the one after it.
    """
    w = Window.partitionBy("symbol").orderBy("seq")
    o = observed.select("*", F.lead("revision").over(w).alias("next"), F.last("body").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("now"))
    other = F.when(F.col("body") != F.col("now"), F.struct("seq", "revision", "next"))
    g = o.groupBy("symbol").agg(F.min(F.struct("seq", "revision")).alias("a"), F.max(other).alias("b"))
    return g.select("symbol", F.col("a.revision").alias("first_seen_rev"), F.col("b.revision").alias("last_modified_rev"), F.col("b.next").alias("changed_at_rev"))


def signed_pairs(added: DataFrame, retired: DataFrame, max_paths: int = 100) -> DataFrame:
    """left_path, right_path, n: what the pairs of commits added, less those of commits retired, change in the counts."""
    return cochange_pairs(added, max_paths).unionByName(cochange_pairs(retired, max_paths).withColumn("n", -F.col("n")))


def signed_touches(added: DataFrame, retired: DataFrame) -> DataFrame:
    """path, n: what commits added and retired change in the touches."""
    count = lambda df, sign: df.groupBy("path").agg((F.count("*") * sign).alias("n"))
    return count(added, 1).unionByName(count(retired, -1))


def merged_counts(stored: DataFrame, *deltas: DataFrame, tasks: int | None = None) -> DataFrame:
    """Stored counts (keys and n) with signed deltas of the same columns; what comes to nothing goes.

    A rewritten branch is a delta of its new commits and, with the other sign, its old ones: history isn't counted anew.
    Counts are dealt out among ``tasks``, if given.
    """
    every, keys = reduce(DataFrame.unionByName, deltas, stored), [c for c in stored.columns if c != "n"]
    return (every.repartition(tasks, *keys) if tasks else every).groupBy(*keys).agg(F.sum("n").alias("n")).where("n != 0")


def recent_commits(commits: DataFrame, depth: int = 500) -> DataFrame:
    """The newest ``depth`` commits, newest first."""
    return commits.orderBy(F.desc("ts"), F.desc("revision")).limit(depth)
