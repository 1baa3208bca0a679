"""Logical views of a repository over the driver's tables; each is a lazy projection of parquet scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Views:
    """The views of one data folder; a scan is planned when a view is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @property
    def commits(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("revision"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))

    @property
    def all_changes(self) -> DataFrame:
        """``changes`` with those that repeat."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("revision"), F.concat(F.lit("part_"), "l_partkey").alias("path"))

    @property
    def changes(self) -> DataFrame:
        return self.all_changes.distinct()

    @property
    def files(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.concat(F.lit("file_"), "doc_id").alias("id"), F.col("source").alias("root_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash"), F.octet_length("text").alias("size_bytes"), F.col("lang").alias("language"))

    @property
    def lines(self) -> DataFrame:
        d = self.table("documents").select("doc_id", F.col("source").alias("root_id"), F.concat_ws("/", "lang", F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        return d.select("doc_id", "root_id", "path", (F.col("pos") + 1).alias("line_number"), "line")

    @property
    def nodes(self) -> DataFrame:
        one = lambda t, key, name: self.table(t).select(F.concat(F.lit(t + "_"), key).alias("id"), F.col(name).alias("label"), F.lit(t).alias("type"))
        return reduce(DataFrame.unionByName, [one("region", "r_regionkey", "r_name"), one("nation", "n_nationkey", "n_name"), one("customer", "c_custkey", "c_name"), one("supplier", "s_suppkey", "s_name"), one("part", "p_partkey", "p_name")])

    def edges_of(self, kind: str) -> DataFrame:
        link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a + "_"), x).alias("src"), F.concat(F.lit(b + "_"), y).alias("dst"))
        if kind == "defines":
            out = link(self.table("nation"), "region", "n_regionkey", "nation", "n_nationkey")
            out = out.union(link(self.table("customer"), "nation", "c_nationkey", "customer", "c_custkey")).union(link(self.table("supplier"), "nation", "s_nationkey", "supplier", "s_suppkey"))
        elif kind == "calls":
            out = link(self.table("lineitem"), "supplier", "l_suppkey", "part", "l_partkey").distinct()
        elif kind == "imports":
            bought = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(self.table("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey")
            out = link(bought, "customer", "o_custkey", "part", "l_partkey").distinct()
        elif kind == "governs":
            out = self.table("part").select(F.concat(F.lit("brand_"), "p_brand").alias("src"), F.concat(F.lit("part_"), "p_partkey").alias("dst"))
        else:
            raise ValueError(f"no edges of kind {kind!r}")
        return out.select("src", "dst", F.lit(kind).alias("kind"))

    def edges(self, *kinds: str) -> DataFrame:
        return reduce(DataFrame.unionByName, map(self.edges_of, kinds or ("defines", "calls", "imports", "governs")))

    @property
    def symbols(self) -> DataFrame:
        p = self.table("part")
        return p.select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.col("p_brand").alias("file"), F.concat_ws("::", "p_brand", "p_type", "p_name").alias("qualified_name"), F.col("p_name").alias("display_name"), F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("doc_comment"), F.when(F.col("p_size") % 3 == 0, "public").when(F.col("p_size") % 3 == 1, "crate").otherwise("private").alias("visibility"), "p_size", "p_retailprice")

    def fingerprints(self, year: int) -> DataFrame:
        """(file, element): the parts that a customer ordered in a year."""
        o = self.table("orders").where(F.year("o_orderdate") == year).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("file"))
        return o.join(self.table("lineitem").select("l_orderkey", "l_partkey"), "l_orderkey").select("file", F.col("l_partkey").alias("element")).distinct()

    @property
    def events(self) -> DataFrame:
        return self.table("events")

    @property
    def vectors(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


#: The same views for the SQL that an independent engine runs.
SQL = {
    "commits": "commits AS (SELECT o_orderkey AS revision, o_custkey AS author, o_orderdate AS ts FROM orders)",
    "changes": "changes AS (SELECT DISTINCT l_orderkey AS revision, 'part_' || l_partkey AS path FROM lineitem)",
    "files": "files AS (SELECT 'file_' || doc_id AS id, source AS root_id, lang || '/' || doc_id AS path, text AS content, sha256(text) AS content_hash, strlen(text) AS size_bytes, lang AS language FROM documents)",
    "lines": "lines AS (SELECT doc_id, source AS root_id, lang || '/' || doc_id AS path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM documents)",
    "nodes": """nodes AS (SELECT 'region_' || r_regionkey AS id, r_name AS label, 'region' AS type FROM region UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'nation' FROM nation
UNION ALL SELECT 'customer_' || c_custkey, c_name, 'customer' FROM customer UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'supplier' FROM supplier UNION ALL SELECT
'part_' || p_partkey, p_name, 'part' FROM part)""",
    "defines": """defines AS (SELECT 'region_' || n_regionkey AS src, 'nation_' || n_nationkey AS dst, 'defines' AS kind FROM nation UNION ALL SELECT 'nation_' || c_nationkey, 'customer_'
|| c_custkey, 'defines' FROM customer UNION ALL SELECT 'nation_' || s_nationkey, 'supplier_' || s_suppkey, 'defines' FROM supplier)""",
    "calls": "calls AS (SELECT DISTINCT 'supplier_' || l_suppkey AS src, 'part_' || l_partkey AS dst, 'calls' AS kind FROM lineitem)",
    "imports": "imports AS (SELECT DISTINCT 'customer_' || o_custkey AS src, 'part_' || l_partkey AS dst, 'imports' AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "governs": "governs AS (SELECT 'brand_' || p_brand AS src, 'part_' || p_partkey AS dst, 'governs' AS kind FROM part)",
    "symbols": """symbols AS (SELECT 'part_' || p_partkey AS id, p_brand AS file, p_brand || '::' || p_type || '::' || p_name AS qualified_name, p_name AS display_name, CASE WHEN p_size %
5 <> 0 THEN p_type END AS doc_comment, CASE p_size % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'crate' ELSE 'private' END AS visibility, p_size, p_retailprice FROM part)""",
    "fingerprints": "fingerprints AS (SELECT DISTINCT year(o_orderdate) AS rev, o_custkey AS file, l_partkey AS element FROM orders JOIN lineitem ON o_orderkey = l_orderkey)",
    "vectors": "vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)",
}


def sql_with(views: str, body: str) -> str:
    """``body`` after the named views, and after its own WITH items if it begins with a comma."""
    named = ", ".join(SQL[v] for v in views.split())
    return f"WITH {named}{body}" if body.lstrip().startswith(",") else f"WITH {named} {body}"
