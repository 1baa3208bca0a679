"""Packing of results into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(value, most))


def prefix_cut(rows: DataFrame, by: str, order: list, cost: str, budget: int) -> DataFrame:
    """Rows of each group while their running cost is within ``budget``, the first in any case."""
    w = Window.partitionBy(by).orderBy(*order)
    r = rows.select("*", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("spent"), F.row_number().over(w).alias("place"))
    return r.where((F.col("spent") <= budget) | (F.col("place") == 1))


def knapsack(rows: DataFrame, by: str, order: str, cost: str, budget: int) -> DataFrame:
    """Rows of each group taken in order, passing over those that don't fit any more.

    The fold is sequential, over one array a group; groups are the few targets of one request.
    """
    items = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("long").alias("c")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast(f"array<{rows.schema[order].dataType.simpleString()}>").alias("kept"))
    fits = lambda a, x: a["spent"] + x["c"] <= budget
    folded = F.aggregate("items", start, lambda a, x: F.struct(F.when(fits(a, x), a["spent"] + x["c"]).otherwise(a["spent"]).alias("spent"), F.when(fits(a, x), F.concat(a["kept"], F.array(x["o"]))).otherwise(a["kept"]).alias("kept")))
    return items.select(by, folded.alias("f")).select(by, F.col("f.spent").alias("spent"), F.col("f.kept").alias("kept"))


def with_omitted(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows and on each how many more there were; counted by partial sums, not in a window over all rows."""
    n = rows.agg(F.greatest(F.count("*") - limit, F.lit(0).cast("long")).alias("omitted"))
    return rows.orderBy(*order).limit(limit).crossJoin(F.broadcast(n))


def drop_sections(costs: list[tuple[str, int]], budget: int, order: list[str]) -> list[str]:
    """The sections left when those in ``order`` are dropped one by one until the rest fits."""
    left = dict(costs)
    for name in order:
        if sum(left.values()) <= budget:
            break
        left.pop(name, None)
    return list(left)


def confidence(mean_lcs: Column, spans: Column, length: Column, over: Column) -> Column:
    """0.7 of the mean ratio, 0.2 for two or more spans or 0.1 for one, up to 0.1 for length, less 0.1 for each of at most 3 excess spans."""
    raw = mean_lcs * 0.7 + F.when(spans >= 2, 0.2).when(spans == 1, 0.1).otherwise(0.0) + F.least(length / 64, F.lit(1.0)) * 0.1 - F.least(over, F.lit(3)) * 0.1
    return F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0))


def tier(score: Column, high: float = 0.85, review: float = 0.6) -> Column:
    return F.when(score >= high, "high").when(score >= review, "review_queue").otherwise("below_threshold")


def demoted_tier(score: Column, weakest: Column, strong: float = 0.9) -> Column:
    """The tier of a score, where high stands only if the weakest span is strong too."""
    t = tier(score)
    return F.when((t == "high") & (weakest < strong), "review_queue").otherwise(t)
