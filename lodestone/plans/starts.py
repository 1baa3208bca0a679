"""Queries of the kept adjacency and of many starts at once, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adjacency
from ..sources.views import Views, sql_with
from .catalog import ALL, DEGREES, EDGES  # noqa: F401
from .registry import query

#: The adjacency of each data folder that this process has built.
_BUILT: dict[tuple[str, str], adjacency.Adjacency] = {}


def store_of(v: Views) -> adjacency.Adjacency:
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _BUILT:
        _BUILT[key] = adjacency.Adjacency.save(v.edges(), buckets=16, hub=5000)
    return _BUILT[key]


def _level(d: int) -> str:
    return f"""n{d} AS (SELECT DISTINCT start, b AS id FROM ways JOIN k{d - 1} ON a = id AND depth = {d - 1} WHERE (start, b) NOT IN (SELECT (start, id) FROM k{d - 1})),
k{d} AS (SELECT * FROM (SELECT * FROM k{d - 1} UNION ALL SELECT start, id, {d}, degree FROM n{d} JOIN degrees USING (id)) QUALIFY row_number() OVER (PARTITION BY start ORDER BY depth, degree DESC, id) <= 30)"""


WAYS = "ways AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges)"


@query(sql_with(ALL, DEGREES + f", {WAYS}, k0 AS (SELECT id AS start, id, 0 AS depth, degree FROM degrees WHERE id LIKE 'nation_%' OR id LIKE 'supplier_%'), {_level(1)}, {_level(2)} SELECT start, id, depth::INT AS depth, degree FROM k2"))
def all_neighborhoods(v: Views) -> DataFrame:
    """The neighbourhoods of all nations and suppliers in one job a level."""
    starts = v.nodes.where(F.col("type").isin("nation", "supplier")).select(F.col("id").alias("start"))
    return adjacency.neighborhoods(store_of(v), starts, 2, 30)


@query(sql_with(ALL, f", edges AS ({EDGES}), {WAYS}, s AS (SELECT 'region_' || r_regionkey AS start FROM region), d1 AS (SELECT DISTINCT start, b AS id FROM s JOIN ways ON a = start), d2 AS (SELECT DISTINCT start, b AS id FROM d1 JOIN ways ON a = id)"
" SELECT start, id, min(d)::INT AS distance FROM (SELECT start, start AS id, 0 AS d FROM s UNION ALL SELECT start, id, 1 FROM d1 UNION ALL SELECT start, id, 2 FROM d2) GROUP BY start, id"))
def all_distances(v: Views) -> DataFrame:
    starts = v.table("region").select(F.concat(F.lit("region_"), "r_regionkey").alias("start"))
    return adjacency.distances_from(store_of(v), starts, 2)


@query(sql_with(ALL, f", edges AS ({EDGES}) SELECT src AS b, kind, false AS out FROM edges WHERE dst = 'part_7' UNION ALL SELECT dst, kind, true FROM edges WHERE src = 'part_7'"))
def incident_edges(v: Views) -> DataFrame:
    """A lookup that reads the buckets of one node."""
    return store_of(v).incident("part_7")


@query(sql_with("vectors", """, m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM vectors) GROUP BY ALL), c AS (SELECT label AS probe, list(x ORDER BY i) AS c FROM m GROUP BY label),
s AS (SELECT probe, vec_id AS id, round(list_cosine_similarity(v, c), 6) AS score FROM vectors, c)
SELECT probe::BIGINT AS probe, id, score FROM s QUALIFY row_number() OVER (PARTITION BY probe ORDER BY score DESC, id) <= 20"""))
def concept_candidates(v: Views) -> DataFrame:
    """The 20 vectors nearest to the mean of each label, all labels at once."""
    x = v.vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).select(F.col("label").cast("long").alias("id"), "v")
    return adjacency.topk_many(v.vectors.select(F.col("vec_id").alias("id"), "v"), means, 20)
