"""A kept adjacency of the graph, and reads from many starts at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import folder, held
from .graph import MAX_DEPTH, MAX_LIMIT

#: Edges of a node that stand in one part; a node of more, a hub, has as many parts as it takes, each in a bucket of its own.
HUB = 100_000
#: Vectors, or probes, of a block.
BLOCK = 2048


def _slot(id_: Column, part: Column) -> Column:
    """The name of a part of a node, by which edges are dealt into buckets; a number after the last ``#`` keeps names apart."""
    return F.concat(id_, F.lit("#"), part.cast("string"))


class Adjacency:
    """Edges from either end, in buckets by node and part, and the degree of each node.

    A set of nodes meets its edges by moving the nodes alone: the edges stand in their buckets, sorted, and are
    not dealt out again.  A lookup of few nodes reads their buckets only.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name

    @classmethod
    def save(cls, edges: DataFrame, name: str | None = None, where: str | None = None, buckets: int = 64, hub: int = HUB) -> Adjacency:
        """Write edges (src, dst, kind) as tables ``name``_ways and ``name``_degrees under ``where``, by default a folder that goes with the process."""
        spark, name = edges.sparkSession, name or f"lodestone_{uuid.uuid4().hex}"
        where = where or folder(spark, "adjacency")
        edges = held(edges.select("src", "dst", "kind"), "edges")  # read twice
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
        ends.select("id", "degree", F.ceil(F.col("degree") / hub).cast("int").alias("parts")).repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", f"{where}/degrees").mode("overwrite").saveAsTable(f"{name}_degrees")
        hubs = F.broadcast(spark.table(f"{name}_degrees").where("parts > 1").select(F.col("id").alias("a"), "parts"))  # at most 2 nodes for each ``hub`` edges
        way = lambda a, b, out: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "kind", F.lit(out).alias("out"))
        ways = edges.select(F.explode(F.array(way("src", "dst", True), way("dst", "src", False))).alias("w")).select("w.*").join(hubs, "a", "left")
        ways = ways.select(_slot(F.col("a"), F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)))).alias("slot"), "a", "b", "kind", "out")
        ways.repartition(buckets, "slot").write.bucketBy(buckets, "slot").sortBy("slot").option("path", f"{where}/ways").mode("overwrite").saveAsTable(f"{name}_ways")
        return cls(spark, name)

    def drop(self) -> None:
        for part in ("ways", "degrees"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    @property
    def ways(self) -> DataFrame:
        return self.spark.table(f"{self.name}_ways")

    @property
    def degrees(self) -> DataFrame:
        return self.spark.table(f"{self.name}_degrees")

    def incident(self, node: str, out: bool | None = None) -> DataFrame:
        """b, kind, out of the edges of one node; only the buckets of its parts are read."""
        found = self.degrees.where(F.col("id") == node).first()
        w = self.ways.where(F.col("slot").isin(*[f"{node}#{i}" for i in range(found["parts"] if found else 1)]))
        return (w if out is None else w.where(F.col("out") == out)).select("b", "kind", "out")

    def steps(self, front: DataFrame, direction: str = "both", kinds: tuple[str, ...] = ()) -> DataFrame:
        """The columns of ``front`` (id and more) with b, a neighbour of id."""
        w = self.ways if direction == "both" else self.ways.where(F.col("out") == (direction == "outbound"))
        w = w.where(F.col("kind").isin(*kinds)) if kinds else w
        parts = self.degrees.select(F.col("id").alias("d_id"), "parts")
        asked = front.join(parts, F.col("id") == F.col("d_id")).select(*front.columns, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("d_part"))
        return asked.withColumn("slot", _slot(F.col("id"), F.col("d_part"))).join(w.select("slot", "b"), "slot").select(*front.columns, "b")


def neighborhoods(store: Adjacency, starts: DataFrame, depth: int = 1, limit: int = 100, direction: str = "both") -> DataFrame:
    """start, id, depth, degree of at most ``limit`` nodes near each of ``starts`` (start): level by level, within a level by (degree descending, id).

    The rows of one start are those of ``graph.neighborhood``; all starts advance together, a level a job, and nothing goes over
    the driver.  Starts that are no node's id, and null ones, have no rows; repeated starts count once.
    """
    depth, limit = max(1, min(depth, MAX_DEPTH)), max(1, min(limit, MAX_LIMIT))
    degrees = store.degrees.select("id", "degree")
    seen = held(starts.select("start").where("start IS NOT NULL").distinct().join(degrees, F.col("start") == F.col("id")).select("start", "id", F.lit(0).alias("depth"), "degree"), "near-0")
    for d in range(1, depth + 1):
        room = seen.groupBy("start").agg((F.lit(limit) - F.count("*")).alias("room")).where("room > 0")
        front = seen.where(F.col("depth") == d - 1).select("start", "id").join(room.select("start"), "start", "left_semi")
        near = store.steps(front, direction).select("start", F.col("b").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        ranked = near.join(degrees, "id").select("start", "id", "degree", F.row_number().over(Window.partitionBy("start").orderBy(F.desc("degree"), "id")).alias("rn")).where(F.col("rn") <= limit)
        new = ranked.join(room, "start").where("rn <= room").select("start", "id", F.lit(d).alias("depth"), "degree")
        seen = held(seen.unionByName(new), f"near-{d}")
    return seen


def distances_from(store: Adjacency, starts: DataFrame, cutoff: int = 2) -> DataFrame:
    """start, id, distance of the nodes at most ``cutoff`` steps from each of ``starts`` (start), either way; the start itself at 0."""
    seen = held(starts.select("start").where("start IS NOT NULL").distinct().select("start", F.col("start").alias("id"), F.lit(0).alias("distance")), "distance-0")
    for d in range(1, cutoff + 1):
        front = seen.where(F.col("distance") == d - 1).select("start", "id")
        new = store.steps(front).select("start", F.col("b").alias("id")).distinct().join(seen.select("start", "id"), ["start", "id"], "left_anti")
        seen = held(seen.unionByName(new.select("start", "id", F.lit(d).alias("distance"))), f"distance-{d}")
    return seen


# ---- nearest vectors of many probes

_BLOCKS = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("m", T.BinaryType()), T.StructField("n", T.IntegerType())])


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (id long, v) as blocks of up to BLOCK unit vectors; a vector of zeros stays zero."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = part.column("v")
                m = np.asarray(v.flatten(), float).reshape(len(v), -1)
                m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([np.asarray(part.column("id"), np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([len(v)], pa.int32())], names=["ids", "m", "n"])

    return rows.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), "v").mapInArrow(pack, _BLOCKS)


def topk_many(vectors: DataFrame, probes: DataFrame, k: int = 20, least: float = -1.0) -> DataFrame:
    """probe, id, score of the ``k`` vectors (id, v) nearest to each of ``probes`` (id, v) by cosine, ``least`` or more; ties by id.

    A stated set of probes meets all vectors block by block: a pair of blocks is one matrix product, which keeps k of each probe, and
    what the pairs keep is merged by rank.  Vectors of one length are expected; null ones are left out.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, probe_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["p_ids"], np.int64)
                scores = np.round(np.frombuffer(row["p_m"]).reshape(row["p_n"], -1) @ np.frombuffer(row["m"]).reshape(row["n"], -1).T, 6)
                p, at = [], []
                for i, s in enumerate(scores):
                    some = np.flatnonzero(s >= least)
                    top = some[np.lexsort((ids[some], -s[some]))[:k]]
                    p.append(np.full(len(top), i))
                    at.append(top)
                p, at = np.concatenate(p), np.concatenate(at)
                yield pa.RecordBatch.from_arrays([pa.array(probe_ids[p]), pa.array(ids[at]), pa.array(scores[p, at])], names=["probe", "id", "score"])

    blocks, asked = held(_blocks(vectors), "vector-blocks"), held(_blocks(probes), "probe-blocks")
    pairs = blocks.join(asked.select(F.col("ids").alias("p_ids"), F.col("m").alias("p_m"), F.col("n").alias("p_n")))
    found = pairs.mapInArrow(best, "probe long, id long, score double")
    return found.select("*", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "id")).alias("rn")).where(F.col("rn") <= k).select("probe", "id", "score")
