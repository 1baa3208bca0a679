"""Versions of tables, many starts, counts with signs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import adjacency, graph, history, search, similarity, upkeep
from lodestone.sources import scratch, tables

SCHEMA = "root_id string, id int, x string"


def _rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_versions(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(ValueError, match="no version yet"):
        t.read()
    first = spark.createDataFrame([("a/b c", 1, "x"), ("b", 2, "y"), (None, 3, "z"), ("b", 4, None)], SCHEMA)
    assert t.overwrite(first) == 1 and _rows(t.read()) == _rows(first)
    before = t.manifest()["folders"]
    assert t.replace_roots(spark.createDataFrame([("b", 5, "new")], SCHEMA), spark.createDataFrame([("b",)], "root_id string")) == 2
    assert _rows(t.read()) == sorted(map(str, [("a/b c", 1, "x"), (None, 3, "z"), ("b", 5, "new")])) and _rows(t.read(1)) == _rows(first)
    after = t.manifest()["folders"]
    assert {k for k in before if after[k] == before[k]} == {k for k in before if not k.endswith("=b")}  # untouched roots keep their files
    with pytest.raises(Exception, match="boom"):  # a write that fails leaves the version before
        t.overwrite(first.select("root_id", "id", F.when(F.col("id") == 4, F.raise_error(F.lit("boom"))).otherwise(F.col("x")).alias("x")))
    with pytest.raises(ValueError, match="aren't touched"):
        t.replace_roots(first, spark.createDataFrame([("b",)], "root_id string"))
    assert t.versions() == [1, 2] and len(_rows(t.read())) == 3
    t.replace_roots(first.limit(0), spark.createDataFrame([(None,), ("b",)], "root_id string"))
    assert _rows(t.read()) == [str(("a/b c", 1, "x"))]
    assert t.vacuum(1) >= 1 and t.versions() == [3] and _rows(t.read()) == [str(("a/b c", 1, "x"))]
    t.overwrite(first.limit(0))
    assert _rows(t.read()) == [] and t.read().schema == first.schema


def test_of_two_writers_one_is_told(spark, tmp_path):
    t = tables.VersionedTable(spark, f"file://{tmp_path}/t")
    stale = t.manifest()
    t.overwrite(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    with pytest.raises(tables.Conflict):
        t._commit(stale, spark.createDataFrame([], SCHEMA).schema, {})
    assert len(_rows(t.read())) == 1


@pytest.fixture(scope="module")
def store(spark):
    rows = [("hub", f"n{i:03d}", "calls") for i in range(60)] + [(f"n{i:03d}", f"n{(i * 7 + 1) % 60:03d}", "imports") for i in range(60)] + [("far", "n001", "calls"), ("self", "self", "calls"), ("far", "n001", "imports")]
    edges = spark.createDataFrame(rows, "src string, dst string, kind string")
    made = adjacency.Adjacency.save(edges, buckets=4, hub=10)
    yield edges, made
    made.drop()


@pytest.mark.parametrize("direction", ["both", "outbound", "inbound"])
def test_neighbourhoods_of_many_starts_are_those_of_each(spark, store, direction):
    edges, made = store
    starts = ["hub", "n003", "far", "self", "nobody", None, "hub"]
    got = adjacency.neighborhoods(made, spark.createDataFrame([(s,) for s in starts], "start string"), 2, 20, direction).collect()
    for s in {"hub", "n003", "far", "self", "nobody"}:
        want = graph.neighborhood(edges, s, 2, 20, direction)
        assert sorted((r.id, r.depth, r.degree) for r in got if r.start == s) == sorted((r.id, r.depth, r.degree) for r in want.collect()), s
    assert not [r for r in got if r.start is None]


def test_distances_and_lookups_by_the_store(spark, store):
    edges, made = store
    got = adjacency.distances_from(made, spark.createDataFrame([("far",), ("hub",)], "start string"), 2).collect()
    for s in ("far", "hub"):
        assert {(r.id, r.distance) for r in got if r.start == s} == {(r.id, r.distance) for r in graph.distances(edges, s, 2).collect()}
    assert made.degrees.where("id = 'hub'").first()["parts"] == 6
    assert made.incident("hub").count() == 60 and _rows(made.incident("far", True)) == _rows(edges.where("src = 'far'").selectExpr("dst", "kind", "true"))
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan of a scan without a join doesn't name the buckets it reads
    plan = made.incident("n001", True)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 4" in plan


def test_steps_move_the_front_alone(spark, store):
    _, made = store
    front = spark.createDataFrame([("far", "far")], "start string, id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so small a table would be broadcast
    plan = made.steps(front).selectExpr("start", "b")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    ways = plan[plan.index("SortMergeJoin [slot") :].split("\n")
    assert "Bucketed: true" in plan and sum("Exchange hashpartitioning(slot" in line for line in ways) == 1


def test_nearest_of_many_probes(spark):
    draw = np.random.default_rng(3)
    v = np.round(draw.normal(size=(5000, 8)), 1)
    v[10] = 0
    v[20:40] = v[50]
    p = np.concatenate([v[:3], np.zeros((1, 8)), v[50:51]])
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(None, [1.0] * 8), (9999, None)], "id long, v array<double>").repartition(3)
    probes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, v array<double>")
    got = adjacency.topk_many(vectors, probes, 15, 0.1).collect()
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(p) @ unit(v).T, 6)
    for i in range(len(p)):
        want = sorted(((-s, k) for k, s in enumerate(scores[i]) if s >= 0.1))[:15]
        assert sorted((-r.score, r.id) for r in got if r.probe == i) == want
    assert adjacency.topk_many(vectors.limit(0), probes).collect() == [] == adjacency.topk_many(vectors, probes.limit(0)).collect()


def test_signed_counts_are_those_of_what_is_left(spark):
    rows = [(c, f"p{k}") for c in range(30) for k in range(c % 5)] + [(1000, f"big{k}") for k in range(300)] + [(1, "p0"), (1001, "only")]
    c = spark.createDataFrame(rows, "revision long, path string")
    gone, new = F.col("revision") % 3 == 0, F.col("revision") % 3 == 1
    kept = history.merged_counts(history.cochange_pairs(c.where(~new)), history.signed_pairs(c.where(new), c.where(gone)))
    assert _rows(kept) == _rows(history.cochange_pairs(c.where(~gone)))
    assert not [r for r in kept.collect() if r.left_path.startswith("big")]
    touched = history.merged_counts(history.signed_touches(c, c.limit(0)), history.signed_touches(c.limit(0), c.where(gone)))
    assert _rows(touched) == _rows(c.where(~gone).groupBy("path").agg(F.count("*").alias("n")))


def test_counters_come_with_the_pass(spark):
    before, after = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "k int, c string"), spark.createDataFrame([(2, "b"), (3, None), (4, "x"), (5, "e")], "k int, c string")
    rows, counters = upkeep.observed_pass(before, after, "k", "c")
    assert {(r.k, r.c, r.what) for r in scratch.held(rows, "pass").collect()} == {(1, "a", "retired"), (2, "b", "unchanged"), (3, None, "unchanged"), (4, "x", "updated"), (5, "e", "inserted")}
    assert counters.get == dict(upkeep.reconcile_counters(before, after, "k", "c").first().asDict())


def test_many_files_of_one_content_meet_once(spark):
    gone = spark.createDataFrame([("r", "h", f"old{i}") for i in range(3)] + [("q", "h", "old9")], "root_id string, content_hash string, path string")
    new = spark.createDataFrame([("r", "h", f"new{i}") for i in range(4)], gone.schema)
    assert _rows(similarity.exact_renames(gone, new)) == sorted(str(("r", f"old{i}", "new0")) for i in range(3))


def test_many_short_items_meet_by_grams(spark):
    items = spark.createDataFrame([(i, f"w{i}") for i in range(40)] + [(100, "two words"), (101, "x\ny")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "say (w7), w12 and two words"), (2, "w3\nw39x"), (3, None), (4, "x\ny")], "doc_id int, text string")
    assert _rows(search.containment(items, docs, few=5)) == _rows(search.containment(items, docs))
