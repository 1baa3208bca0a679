"""Queries by posting lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postings
from ..sources import scratch
from ..sources.views import Views, sql_with
from .registry import query

#: Where the index of each data folder stands that this process has built.
_BUILT: dict[tuple[str, str], str] = {}


def _index(v: Views) -> str:
    """The index of the documents, built once a session."""
    key = (v.spark.sparkContext.applicationId, v.sf_dir)
    if key not in _BUILT:
        where = scratch.folder(v.spark, "lexical-index")
        postings.save_postings(v.files, v.lines, where)
        _BUILT[key] = where
    return _BUILT[key]


def index_of(v: Views) -> tuple[DataFrame, DataFrame]:
    """Its lines with their blocks, and its postings."""
    where = _index(v)
    return v.spark.read.parquet(f"{where}/lines"), v.spark.read.parquet(f"{where}/postings")


@query(sql_with("lines", "SELECT root_id, path, line_number::INT AS line_number, line, strpos(line, 'License')::INT AS \"column\" FROM lines WHERE contains(line, 'License')"))
def indexed_literal(v: Views) -> DataFrame:
    found = postings.search_index(v.spark, _index(v), "License", literal=True)
    return found.withColumn("line_number", F.col("line_number").cast("int"))


@query(sql_with("lines", "SELECT root_id, path, line_number::INT AS line_number FROM lines WHERE regexp_matches(line, '(token|passwd)[^ ]* *= *|api_key: *[a-z]+', 'i')"))
def indexed_regex(v: Views) -> DataFrame:
    found = postings.search_index(v.spark, _index(v), "(token|passwd)[^ ]* *= *|api_key: *[a-z]+", ignore_case=True)
    return found.select("root_id", "path", F.col("line_number").cast("int").alias("line_number"))


@query(sql_with("lines", """, n AS (SELECT DISTINCT lower(substr(text, 3, 14)) AS needle FROM benchmark WHERE length(text) > 16 UNION SELECT DISTINCT lower(substr(text, 1, 2)) FROM benchmark WHERE length(text) >= 2)
SELECT needle, count(DISTINCT path) AS n_files, count(*) AS n_lines FROM n JOIN lines ON contains(lower(line), needle) GROUP BY needle"""))
def indexed_needles(v: Views) -> DataFrame:
    """Pieces of all benchmark items in one pass over the index."""
    b = v.table("benchmark")
    needles = b.where("length(text) > 16").select(F.lower(F.substring("text", 3, 14)).alias("needle")).union(b.where("length(text) >= 2").select(F.lower(F.substring("text", 1, 2))))
    found = postings.search_many(*index_of(v), needles.distinct(), ignore_case=True)
    return found.groupBy("needle").agg(F.count_distinct("path").alias("n_files"), F.count("*").alias("n_lines"))
