"""Tables that cut lineage: written in the shared folder, removed when the process ends."""

from __future__ import annotations

import atexit
import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import shared_dir

_kept: list[tuple[SparkSession, str]] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clear() -> None:
    for spark, path in _kept:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended; the folder is scratch space
            pass


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the shared one, removed when the process ends."""
    path = f"{shared_dir(spark)}/lodestone/{tag}-{uuid.uuid4().hex}"
    _kept.append((spark, path))
    return path


def held(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to such a folder and read back: what reads it twice computes it once, and a lost executor costs no more than a task."""
    path = folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(spark: SparkSession, rows: float, each: int) -> int:
    """How many tasks get about ``each`` of ``rows``, as many as there are cores at least: what one task holds doesn't grow with a table."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / each))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, as of one small file, dealt out to all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int = 1000) -> DataFrame:
    """``left.join(right, key)`` where one key may have many rows on either side: those of ``right`` are dealt into parts of about ``rows``, and each part
    meets those of ``left`` in a task of its own.  The partitions aren't joined again by their size, which tells nothing of the pairs to come."""
    n = right.groupBy(key).agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    r = right.join(n, key).withColumn("part", F.pmod(F.xxhash64(*[c for c in right.columns if c != key]), F.col("parts")).cast("int")).drop("parts")
    l = left.join(n, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    count = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return l.repartition(count, key, "part").join(r.repartition(count, key, "part"), [key, "part"]).drop("part")


def hot_pairs(left: DataFrame, right: DataFrame, key: str, left_rows: int = 4000, rows: int = 1000) -> DataFrame:
    """As ``hot_join``, where the pairs are far more than the rows: both sides of a key are dealt, so that a task meets at most some ``left_rows`` of one
    side with some ``rows`` of the other at a time, and the latter come in one row, so that no pair is looked up.  There are as many tasks as keep about
    two such blocks each."""
    spark, more = left.sparkSession, [c for c in right.columns if c != key]
    n = left.groupBy(key).agg(F.count("*").alias("l")).join(right.groupBy(key).agg(F.count("*").alias("r")), key)
    n = held(n.select(key, F.ceil(F.col("l") / left_rows).cast("int").alias("l_parts"), F.ceil(F.col("r") / rows).cast("int").alias("r_parts"), (F.col("l") * F.col("r")).alias("pairs")), "dealt")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((n.agg(F.sum("pairs")).first()[0] or 0) / (2 * left_rows * rows)))
    place = lambda df, parts: F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    n = n.drop("pairs")
    r = right.join(n, key).withColumn("part", place(right, "r_parts")).groupBy(key, "part", "l_parts").agg(F.collect_list(F.struct(*more)).alias("met")).withColumn("l_part", each("l_parts")).drop("l_parts")
    l = left.join(n, key).withColumn("l_part", place(left, "l_parts")).withColumn("part", each("r_parts")).drop("l_parts", "r_parts")
    keys = [key, "part", "l_part"]
    return l.repartition(count, *keys).join(r.repartition(count, *keys), keys).select(*left.columns, F.inline("met"))
