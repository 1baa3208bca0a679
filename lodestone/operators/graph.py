"""Reads of the property graph: incident edges, degrees, bounded traversal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .budget import with_omitted

MAX_DEPTH, MAX_LIMIT = 3, 500
MAX_CALL_DEPTH = 12


def outbound(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    e = edges.where(F.col("src") == node)
    return e.where(F.col("kind") == kind) if kind else e


def inbound(edges: DataFrame, node: str, kind: str | None = None) -> DataFrame:
    e = edges.where(F.col("dst") == node)
    return e.where(F.col("kind") == kind) if kind else e


def edges_report(edges: DataFrame, node: str, direction: str, limit: int = 100) -> DataFrame:
    """At most ``limit`` incident edges by (kind, src, dst), and how many were left out."""
    e = (outbound if direction == "outbound" else inbound)(edges, node)
    return with_omitted(e.select("src", "dst", "kind"), ["kind", "src", "dst"], max(1, min(limit, MAX_LIMIT)))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy(F.concat(F.lit("node:"), "type").alias("what")).agg(F.count("*").alias("n"))
    return n.unionByName(edges.groupBy(F.concat(F.lit("edge:"), "kind").alias("what")).agg(F.count("*").alias("n")))


def degree_map(edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree of each end of an edge."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def top_degree_overview(edges: DataFrame, limit: int = 25) -> DataFrame:
    """The nodes of highest degree and the number of edges among them."""
    top = degree_map(edges).orderBy(F.desc("degree"), "id").limit(limit).select("id", "degree")
    held = edges.join(F.broadcast(top.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(top.select(F.col("id").alias("dst"))), "dst", "left_semi")
    inner = degree_map(held).select("id", F.col("degree").alias("induced"))
    return top.join(inner, "id", "left").select("id", "degree", F.coalesce("induced", F.lit(0)).alias("induced"))


def _ways(edges: DataFrame, direction: str) -> DataFrame:
    out, back = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    return {"outbound": out, "inbound": back}.get(direction) or out.unionByName(back)


def degrees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, degree of the nodes ``ids`` (id) alone; edges of others aren't counted."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).join(ids, "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))


def neighborhood(edges: DataFrame, start: str, depth: int = 1, limit: int = 100, direction: str = "both", kinds: tuple[str, ...] = ()) -> DataFrame:
    """id, depth, degree of at most ``limit`` nodes near ``start``, by edges of ``kinds`` if any are named: level by level, within a level by (degree descending, id).

    What is kept is bounded by ``limit``, at most MAX_LIMIT rows; these alone go over the driver, as literals that
    reach the scans of the edges, and degrees are counted of the nodes met.
    """
    depth, limit = max(1, min(depth, MAX_DEPTH)), max(1, min(limit, MAX_LIMIT))
    spark, schema = edges.sparkSession, "id string, depth int, degree long"
    edges = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    ways = _ways(edges, direction)
    own = edges.agg(F.sum((F.col("src") == start).cast("long") + (F.col("dst") == start).cast("long"))).first()[0]
    rows = [(start, 0, own)] if own else []
    for d in range(1, depth + 1):
        front = [r[0] for r in rows if r[1] == d - 1]
        if not front or len(rows) >= limit:
            break
        near = ways.where(F.col("a").isin(*front) & ~F.col("b").isin(*[r[0] for r in rows])).select(F.col("b").alias("id")).distinct()
        near = degrees_of(edges, near).orderBy(F.desc("degree"), "id").limit(limit - len(rows))
        rows += [(r["id"], d, r["degree"]) for r in near.collect()]
    return spark.createDataFrame(rows, schema)


def neighborhood_edges(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """The edges whose ends are both among the ``kept`` nodes of a neighborhood."""
    return edges.join(F.broadcast(kept.select(F.col("id").alias("src"))), "src", "left_semi").join(F.broadcast(kept.select(F.col("id").alias("dst"))), "dst", "left_semi").select("src", "dst", "kind")


def distances(edges: DataFrame, start: str, cutoff: int = 2) -> DataFrame:
    """id, distance of the nodes at most ``cutoff`` steps from ``start``, either way."""
    ways = _ways(edges, "both")
    found = edges.sparkSession.createDataFrame([(start, 0)], "id string, distance int")
    for d in range(1, cutoff + 1):
        step = ways.join(found.where(F.col("distance") == d - 1).select(F.col("id").alias("a")), "a").select(F.col("b").alias("id"), F.lit(d).alias("distance"))
        found = found.unionByName(step).groupBy("id").agg(F.min("distance").alias("distance"))
    return found


def call_paths(calls: DataFrame, entries: DataFrame, target: str, depth: int = 8, per_entry: int = 3) -> DataFrame:
    """entry, path of the ways on which an entry point reaches ``target``, entry first.

    Goes backwards level by level.  A node is met once at each length, by its least
    predecessor path, and an entry point isn't passed.  At most ``per_entry`` paths an entry.
    """
    depth = max(1, min(depth, MAX_CALL_DEPTH))
    front = calls.sparkSession.createDataFrame([(target, [target])], "id string, path array<string>")
    found = []
    for _ in range(depth):
        back = calls.select(F.col("src").alias("caller"), F.col("dst").alias("id")).join(front, "id").where(~F.array_contains("path", F.col("caller")))
        step = back.select(F.col("caller").alias("id"), F.concat(F.array("caller"), "path").alias("path")).groupBy("id").agg(F.min("path").alias("path"))
        hit = step.join(entries, "id", "left_semi")
        found.append(hit.select(F.col("id").alias("entry"), "path"))
        front = step.join(entries, "id", "left_anti")
    paths = reduce(DataFrame.unionByName, found).select("*", F.row_number().over(Window.partitionBy("entry").orderBy("path")).alias("rn"))
    return paths.where(F.col("rn") <= per_entry).select("entry", F.array_join("path", ">").alias("path"))


def resolve_targets(targets: DataFrame, nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """target, id, tier of each of a few ``targets`` (target).

    1 the id of a node, 2 its label, 3 the least symbol whose qualified or last name it is,
    4 the least symbol whose qualified name contains it.
    """
    t, last = F.broadcast(targets), F.element_at(F.split("qualified_name", "::"), -1)
    tiers = [
        nodes.join(t, F.col("id") == F.col("target")).select("target", "id", F.lit(1).alias("tier")),
        nodes.join(t, F.col("label") == F.col("target")).select("target", "id", F.lit(2).alias("tier")),
        symbols.join(t, (F.col("qualified_name") == F.col("target")) | (last == F.col("target"))).select("target", "id", F.lit(3).alias("tier")),
        symbols.join(t, F.col("qualified_name").contains(F.col("target"))).select("target", "id", F.lit(4).alias("tier")),
    ]
    best = reduce(DataFrame.unionByName, tiers).groupBy("target").agg(F.min(F.struct("tier", "id")).alias("b"))
    return best.select("target", F.col("b.id").alias("id"), F.col("b.tier").alias("tier"))


def change_impact(edges: DataFrame, node: str) -> DataFrame:
    """direction, id, kind of the nodes that calls or imports link to ``node``; one may be there for either direction."""
    e = edges.where(F.col("kind").isin("calls", "imports"))
    back = inbound(e, node).select(F.lit("inbound").alias("direction"), F.col("src").alias("id"), "kind")
    return back.unionByName(outbound(e, node).select(F.lit("outbound").alias("direction"), F.col("dst").alias("id"), "kind")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target isn't among ``nodes`` (id)."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst", "kind")


def orphans(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (src, dst) either end of which isn't among ``nodes`` (id)."""
    live = links.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return links.join(live.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("src", "dst")


def change_risk(drift: DataFrame, cochange: DataFrame, touches: DataFrame) -> DataFrame:
    """path, score, level: 0.4 drift + 0.3 co-change + 0.3 touches, the counts against ten.

    ``drift`` has path and score, ``cochange`` pairs (left_path, right_path, n), both ends of which count,
    ``touches`` path and touches.
    """
    ends = cochange.select(F.col("left_path").alias("path")).unionByName(cochange.select(F.col("right_path").alias("path"))).groupBy("path").agg(F.count("*").alias("partners"))
    of_ten = lambda c: F.least(F.coalesce(c, F.lit(0)) / 10, F.lit(1.0))
    j = touches.join(drift.select("path", F.col("score").alias("drift")), "path", "left").join(ends, "path", "left")
    j = j.select("path", F.round(F.coalesce("drift", F.lit(0.0)) * 0.4 + of_ten(F.col("partners")) * 0.3 + of_ten(F.col("touches")) * 0.3, 6).alias("score"))
    return j.select("*", F.when(F.col("score") >= 0.8, "critical").when(F.col("score") >= 0.6, "high").when(F.col("score") >= 0.4, "medium").otherwise("low").alias("level"))


def resolve_calls(refs: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """Call references (ref, name, file, kind, prefix) joined to symbols (id, name, file, kind, visibility, qualified_name) by short name.

    A candidate scores +100 in the same file, +50 if its file is imported (file, target_file),
    +20 public or +10 crate, -100 private elsewhere, +30 of the asked kind, +40 under the asked
    prefix.  The best stay if above 0; those that tie under 50 go, those that tie at 50 or more all stay.
    """
    s = symbols.select(F.col("id").alias("s_id"), F.col("name"), F.col("file").alias("s_file"), F.col("kind").alias("s_kind"), "visibility", "qualified_name")
    c = refs.join(s, "name").join(imported.select("file", F.col("target_file").alias("s_file"), F.lit(True).alias("known")).distinct(), ["file", "s_file"], "left")
    same = F.col("file") == F.col("s_file")
    score = (
        F.when(same, 100).otherwise(0)
        + F.when(F.col("known"), 50).otherwise(0)
        + F.when(F.col("visibility") == "public", 20).when(F.col("visibility") == "crate", 10).when((F.col("visibility") == "private") & ~same, -100).otherwise(0)
        + F.when(F.col("kind") == F.col("s_kind"), 30).otherwise(0)
        + F.when(F.col("prefix").isNotNull() & F.col("qualified_name").startswith(F.col("prefix")), 40).otherwise(0)
    )
    best = c.select("*", score.alias("score")).where("score > 0").select("*", F.rank().over(Window.partitionBy("ref").orderBy(F.desc("score"))).alias("rank")).where("rank = 1")
    tied = best.select("*", F.count("*").over(Window.partitionBy("ref")).alias("ties"))
    return tied.where("ties = 1 OR score >= 50").select("ref", F.col("s_id").alias("symbol"), "score")
