"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, n_words_of, text_of

#: A document's key has LEVELS * BITS bits; each level of the histogram splits one bucket into 2**BITS.
BITS, LEVELS = 12, 4


def sample_key(id_: Column) -> Column:
    """The first 48 bits of md5 of the id as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """source, source_size, target: the budget shared by weight, none above max_repeat times its source.

    ``sized`` has source and size.  Sources are ordered by code point, null last, and take the
    weights in turn.  With sources ordered by size per weight, those held at their limit are a
    prefix of that order, so resharing until none is above is one running sum.
    """
    named = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = reduce(lambda rest, k: F.when(F.col("turn") % len(weights) == k, F.lit(weights[k])).otherwise(rest), range(len(weights)), F.lit(None).cast("int"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("turn").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    named = named.select("*", turn.alias("turn")).select("*", w.cast("long").alias("w"))
    named = named.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum(F.col("source_size") * max_repeat).over(before), F.lit(0)).alias("held"),
        F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("open_w"),
    )
    limit = F.col("source_size") * max_repeat
    capped = limit.cast("double") * F.col("open_w") <= (F.col("total") - F.col("held")).cast("double") * F.col("w")
    named = named.select("*", capped.alias("capped"))
    named = named.select(
        "*",
        F.coalesce(F.sum(F.when(F.col("capped"), limit)).over(every), F.lit(0)).alias("all_held"),
        F.coalesce(F.sum(F.when(~F.col("capped"), F.col("w"))).over(every), F.lit(1)).alias("all_open_w"),
    )
    level = (F.col("total") - F.col("all_held")).cast("double") / F.col("all_open_w").cast("double")
    return named.select("source", "source_size", F.when(F.col("capped"), limit.cast("double")).otherwise(F.col("w") * level).alias("target"))


def hash_thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold: rows of a source with key < threshold sum to its budget, as near as a row allows.

    ``sized`` has source, size and key, ``budgets`` source and budget.  A level sums sizes by source and
    bucket of the key's next bits, finds the bucket in which the budget ends, and hands only
    that bucket to the next level; nothing is sorted but the buckets of a source.  Rows of one
    key at the end are taken together if that comes nearer.
    """
    edge = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("left"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        e = edge.select(F.col("source").alias("e_source"), "prefix", "left")
        inside = sized.join(e, sized["source"].eqNullSafe(e["e_source"]) & (F.shiftright(sized["key"], shift + BITS) == e["prefix"]))
        counts = inside.groupBy("source", F.shiftright("key", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.first("left").alias("left"))
        by = Window.partitionBy("source").orderBy("bucket")
        running = counts.select("*", F.sum("n").over(by).alias("through"), F.lead("bucket").over(by).isNull().alias("last"))
        # the first bucket whose sum passes what is left; else the last one
        ends = running.where((F.col("through") > F.col("left")) | F.col("last"))
        edge = ends.groupBy("source").agg(F.min(F.struct("bucket", (F.col("left") - F.col("through") + F.col("n")).alias("left"), "n")).alias("b"))
        edge = edge.select("source", F.col("b.bucket").alias("prefix"), F.col("b.left").alias("left"), F.col("b.n").alias("n"))
    return edge.select("source", (F.col("prefix") + F.when((F.col("left") > 0) & (F.col("left") * 2 >= F.col("n")), 1).otherwise(0)).alias("threshold"))


def mixing_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """p_source, source_size, target, whole, threshold: how often a source is taken whole, and which keys once more."""
    plan = durable(source_targets(sized, weights, max_repeat).select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole")), "mixing-targets")
    cut = hash_thresholds(sized, plan.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    plan = plan.join(cut.withColumnRenamed("source", "c_source"), plan["source"].eqNullSafe(F.col("c_source")))
    return plan.select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.when((F.col("target") > F.col("whole") * F.col("source_size")), F.col("threshold")).otherwise(0).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return durable(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words_of(text_of(text_col)).alias("size"), sample_key(F.col(id_col)).alias("key")), "mixing-sizes")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of each row of ``docs``.

    Each source's share of all words follows its weight; a source is repeated whole
    floor(target / source_size) times and the rest is taken by hash threshold.

    Nulls: a null text has size 0, a null source is a source of its own, the last one, and a
    null id is hashed as the empty text.  Empty texts are taken or not like others and add no
    words.  Repeated rows and rows with one id count one by one and share their fate.  An
    empty table gives no rows.  Other columns aren't read, whatever their names.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = mixing_plan(sized, weights, max_repeat)
    copies = F.col("whole") + F.when(F.col("key") < F.col("threshold"), 1).otherwise(0)
    return sized.join(plan, sized["source"].eqNullSafe(plan["p_source"])).select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and more) that the mix takes, with copies, how often it takes them.

    All other columns stay as they are, whatever their names; one named copies is replaced.

    Nulls, empty texts, repeated rows and empty tables as in ``mix_sources``.
    """
    plan = durable(mixing_plan(_sized(docs, "doc_id", "text", "source"), **options), "mixing-plan").select("whole", "threshold", "p_source").toDF("__whole", "__threshold", "__source")
    copies = (F.col("__whole") + F.when(sample_key(F.col("doc_id")) < F.col("__threshold"), 1).otherwise(0)).cast("long")
    held = docs.join(plan, docs["source"].eqNullSafe(plan["__source"])).withColumn("__copies", copies).where("__copies > 0")
    return held.select(*[F.col(c) for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM sized GROUP BY source),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS w, sum(source_size) OVER ()::BIGINT AS total FROM s),
h AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS held,
             sum(w) OVER (ORDER BY source_size / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w FROM w),
c AS (SELECT *, (3 * source_size)::DOUBLE * open_w <= (total - held)::DOUBLE * w AS capped FROM h),
t AS (SELECT *, coalesce(sum(CASE WHEN capped THEN 3 * source_size END) OVER (), 0)::BIGINT AS all_held,
             coalesce(sum(CASE WHEN NOT capped THEN w END) OVER (), 1)::BIGINT AS all_open FROM c),
p AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE w * ((total - all_held)::DOUBLE / all_open::DOUBLE) END AS target FROM t),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM p),
k AS (SELECT source, key, sum(size)::BIGINT AS n FROM sized GROUP BY source, key),
r AS (SELECT k.source, k.key, k.n, sum(k.n) OVER (PARTITION BY k.source ORDER BY k.key) - k.n AS before, q.target - q.whole * q.source_size AS budget
      FROM k JOIN q ON k.source IS NOT DISTINCT FROM q.source),
m AS (SELECT source, key FROM r WHERE budget > 0 AND (before + n <= budget OR (before < budget AND (budget - before) * 2 >= n))),
x AS (SELECT source, max(key) AS last FROM m GROUP BY source)
SELECT d.doc_id, d.source, d.size, q.source_size, q.target, (q.whole + CASE WHEN d.key <= x.last THEN 1 ELSE 0 END)::BIGINT AS copies,
       ((q.whole + CASE WHEN d.key <= x.last THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
