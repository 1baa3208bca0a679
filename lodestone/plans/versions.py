"""Queries of versioned tables, signed counts and observed passes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import history, upkeep
from ..sources import scratch, tables
from ..sources.views import Views, sql_with
from .registry import query


@query("SELECT source AS root_id, doc_id, CASE WHEN source IN ('src1', 'src3') THEN upper(lang) ELSE lang END AS lang FROM documents WHERE NOT (source IN ('src1', 'src3') AND doc_id % 5 = 0) AND source <> 'src4'")
def versioned_roots(v: Views) -> DataFrame:
    """Three roots of a kept table are computed anew, one of them to nothing; the others keep their files."""
    d = v.table("documents").select(F.col("source").alias("root_id"), "doc_id", "lang")
    kept = tables.VersionedTable(v.spark, scratch.folder(v.spark, "versions"))
    kept.overwrite(d)
    anew = d.where("root_id IN ('src1', 'src3') AND doc_id % 5 != 0").withColumn("lang", F.upper("lang"))
    kept.replace_roots(anew, v.spark.createDataFrame([("src1",), ("src3",), ("src4",)], "root_id string"))
    return kept.read()


PAIRS_KEPT = """, c AS (SELECT * FROM changes WHERE revision % 7 <> 0 AND revision IN (SELECT revision FROM changes GROUP BY revision HAVING count(*) BETWEEN 2 AND 100))
SELECT a.path AS left_path, b.path AS right_path, count(*) AS n FROM c a JOIN c b USING (revision) WHERE a.path < b.path GROUP BY ALL"""


@query(sql_with("changes", PAIRS_KEPT))
def pairs_after_rewrite(v: Views) -> DataFrame:
    """Counts of all commits, less those that a rewrite took away, are the counts of the rest."""
    c = v.all_changes
    return history.merged_counts(history.cochange_pairs(c), history.signed_pairs(c.limit(0), c.where("revision % 7 = 0")), tasks=history.pair_tasks(c))


@query(sql_with("changes", "SELECT path, count(*) AS n FROM changes WHERE revision % 7 <> 0 GROUP BY path"))
def touches_after_rewrite(v: Views) -> DataFrame:
    c = v.changes
    return history.merged_counts(history.signed_touches(c, c.limit(0)), history.signed_touches(c.limit(0), c.where("revision % 7 = 0")))


@query("SELECT count(*) FILTER (p_size % 4 = 2) AS inserted, count(*) FILTER (p_size % 4 = 1) AS updated, count(*) FILTER (p_size % 4 = 0) AS retired, count(*) FILTER (p_size % 4 = 3) AS unchanged FROM part")
def observed_counters(v: Views) -> DataFrame:
    """The counters of a pass, seen while its rows are written."""
    p = v.table("part").select("p_partkey", "p_name", "p_size")
    before = p.where("p_size % 4 != 2").select("p_partkey", F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("old "), "p_name")).otherwise(F.col("p_name")).alias("p_name"))
    rows, counters = upkeep.observed_pass(before, p.where("p_size % 4 != 0"), "p_partkey", "p_name")
    scratch.held(rows, "pass")
    return v.spark.range(1).select(*[F.lit(n).cast("long").alias(w) for w, n in counters.get.items()])
