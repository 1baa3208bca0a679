"""Connected components: the same roots however the edges are dealt, and few tasks for a small graph."""

import random

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import graph


def _roots(edges) -> dict[int, int]:
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = top(u), top(v)
            parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


def _edges(kind: str) -> list[tuple]:
    r = random.Random(11)
    if kind == "empty":
        return []
    if kind == "odd":
        return [(None, 1), (2, None), (5, 5), (9, 8), (8, 9), (9, 8), (-(2**63), 2**63 - 1), (7, -(2**63))]
    if kind == "hub":
        return [(3, x) for x in range(10, 400)] + [(x, x + 1000) for x in range(10, 400, 7)]
    if kind == "path":
        return [(x, x + 1) for x in range(300)]
    order = r.sample(range(10**12), 300)  # a path of nodes in no order, and loose pairs
    return list(zip(order, order[1:])) + [tuple(r.sample(range(10**6), 2)) for _ in range(100)]


def _table(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


@pytest.mark.parametrize("limit", [40, 1 << 19])
@pytest.mark.parametrize("kind", ["empty", "odd", "hub", "path", "mixed"])
def test_components_are_those_of_a_plain_search(spark, monkeypatch, kind, limit):
    monkeypatch.setattr(graph, "EDGES", limit)
    got = graph.components(_table(spark, _edges(kind)), "test-graph").collect()
    assert sorted((r.node, r.root) for r in got) == sorted(_roots(_edges(kind)).items())


@pytest.mark.parametrize("limit", [4, 50, 1000])
@pytest.mark.parametrize("kind", ["empty", "hub", "path", "mixed"])
def test_stars_of_a_task_connect_what_its_edges_connect(monkeypatch, kind, limit):
    monkeypatch.setattr(graph, "EDGES", limit)
    edges = _edges(kind)
    u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 9]), pa.array(v[i : i + 9])], names=["u", "v"]) for i in range(0, len(u), 9)]
    out = [(x["u"], x["v"]) for b in graph._forest(iter(batches)) for x in b.to_pylist()]
    assert _roots(out) == _roots(edges) and all(a > b for a, b in out)
    assert limit < 1000 or len(out) == len({a for a, _ in out})


def test_few_tasks_find_the_components_of_a_small_graph(spark):
    """Rounds of shuffles over every partition took op4_ngram_join beyond its time on many partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = _table(spark, _edges("mixed")).repartition(40, "u")
        spark.sparkContext.setJobGroup("components", "")
        graph.components(edges, "test-tasks")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    told = spark.sparkContext.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("components") for s in told.getJobInfo(j).stageIds}
    assert sum(i.numTasks for s in stages if (i := told.getStageInfo(s))) < 200
