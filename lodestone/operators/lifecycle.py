"""Lifecycle of graph rows: upsert, retire, compact, cascade, incremental sync."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """Stored and incoming rows, the one of highest ``order`` for each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return stored.unionByName(incoming).select("*", F.row_number().over(w).alias("__rn")).where("__rn = 1").drop("__rn")


def missing(stored: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows that discovery no longer finds."""
    return stored.join(found.select(*key), key, "left_anti")


def changed(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, change (added, removed, modified) between two snapshots."""
    j = before.select(key, F.col(content).alias("b")).join(after.select(key, F.col(content).alias("a")), key, "full")
    return j.select(key, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").alias("change")).where("change IS NOT NULL")


def changed_with_renames(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """key, change, new of ``changed``, where a removed and an added row of equal content are one rename (to ``new``, the least)."""
    c = changed(before, after, key, content)
    gone = c.where("change = 'removed'").select(key).join(before.select(key, F.col(content).alias("__c")), key)
    new = c.where("change = 'added'").select(key).join(after.select(key, F.col(content).alias("__c")), key).groupBy("__c").agg(F.min(key).alias("new"))
    moved = gone.groupBy("__c").agg(F.min(key).alias(key)).join(new, "__c").select(key, "new")
    rest = c.join(moved.select(key), key, "left_anti").join(moved.select(F.col("new").alias(key)), key, "left_anti")
    return rest.select(key, "change", F.lit(None).cast(moved.schema["new"].dataType).alias("new")).unionByName(moved.select(key, F.lit("renamed").alias("change"), "new"))


def retire(stored: DataFrame, observed: DataFrame, key: str, revision: int) -> DataFrame:
    """Stored rows (key, retired_at): those not observed retire at ``revision``, those seen again come back."""
    j = stored.join(observed.select(key, F.lit(True).alias("seen")).distinct(), key, "left")
    return j.select(key, F.when(F.col("seen"), F.lit(None)).otherwise(F.coalesce("retired_at", F.lit(revision))).cast("long").alias("retired_at"))


def compact(rows: DataFrame, edges: DataFrame, key: str, before: int) -> tuple[DataFrame, DataFrame]:
    """Rows retired before a revision go, and with them the edges that touch them."""
    gone = rows.where(F.col("retired_at") < before).select(F.col(key).alias("gone"))
    live = edges.join(gone.withColumnRenamed("gone", "src"), "src", "left_anti").join(gone.withColumnRenamed("gone", "dst"), "dst", "left_anti")
    return rows.where(F.col("retired_at").isNull() | (F.col("retired_at") >= before)), live.select("src", "dst")


def cascade_delete(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ``gone`` nodes (id) and all that touches them."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select("src", "dst", "kind")


def sync(index: DataFrame, touched: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """An index after an incremental pass: rows of touched keys are replaced by what they are now, if anything."""
    t = touched.select(key).distinct()
    return index.join(t, key, "left_anti").unionByName(current.join(t, key, "left_semi").select(*index.columns))


def retention(rows: DataFrame, ts: str, cutoff: str) -> DataFrame:
    return rows.where(F.col(ts) >= F.lit(cutoff).cast(rows.schema[ts].dataType))


def owner_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path, root_id: the longest of the few root prefixes (root_id, prefix) that holds a path.

    Meets on each prefix that ends at a folder, an equi-join whatever the number of roots.
    """
    parts = F.split("path", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    j = paths.select("path", F.explode(heads).alias("prefix")).join(roots, "prefix")
    return j.groupBy("path").agg(F.max(F.struct(F.length("prefix").alias("n"), "root_id")).alias("b")).select("path", F.col("b.root_id").alias("root_id"))
