"""Sources and sinks: files, change logs, indexes, exports."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

COMMITS = T.StructType([T.StructField("revision", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("author_name", T.StringType()), T.StructField("committed_at", T.TimestampType()), T.StructField("parent_count", T.IntegerType()), T.StructField("changed_paths", T.ArrayType(T.StringType()))])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names; a local master may do without and gets a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def discover(spark: SparkSession, root: str, *, root_id: str = "primary", redact: tuple[str, ...] = (), max_size: int = 1 << 20) -> DataFrame:
    """root_id, path, size_bytes, class, content, content_hash of the files under a folder; redacted ones are left out."""
    base = root.rstrip("/") + "/"
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", "^(file:/*|[a-z]+://[^/]*)?/*" + "".join("\\" + c if c in r"\.^$+()|{}[]*?" else c for c in base.lstrip("/")), "")
    f = f.select(F.lit(root_id).alias("root_id"), path.alias("path"), F.col("length").alias("size_bytes"), "content")
    if redact:
        f = f.where(~text.redacted(F.col("path"), redact))
    body = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return f.select("root_id", "path", "size_bytes", F.coalesce(text.classify_content(F.col("path"), F.col("size_bytes"), body, max_size), F.lit("skipped_binary")).alias("class"), body.alias("content"), F.sha2("content", 256).alias("content_hash"))


def union_roots(*roots: DataFrame) -> DataFrame:
    """The files of several roots; one root is taken once, by (root_id, path)."""
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return out.dropDuplicates(["root_id", "path"])


def read_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and how many lines were malformed."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return raw.where("_bad IS NULL").drop("_bad"), raw.agg(F.count("_bad").alias("malformed"))


def exploded_changes(commits: DataFrame) -> DataFrame:
    """revision, path of commits with changed_paths."""
    return commits.select("revision", F.explode(F.array_distinct("changed_paths")).alias("path"))


def chunks(symbols: DataFrame, most: int = 512) -> DataFrame:
    """id, text of each symbol, cut at a word."""
    body = F.concat_ws("\n", "qualified_name", "display_name", "doc_comment")
    return symbols.select("id", text.cut_at_word(body, most).alias("text"))


def save_vectors(vectors: DataFrame, path: str, dim: int) -> None:
    """Write vectors (v); any of another dimension stops the job."""
    vectors.withColumn("v", F.when(F.size("v") == dim, F.col("v")).otherwise(F.raise_error(F.lit(f"a vector isn't of dimension {dim}")).cast("array<double>"))).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, dim: int) -> DataFrame:
    v = spark.read.parquet(path)
    return v.where(F.coalesce(F.assert_true(F.size("v") == dim).isNull(), F.lit(True)))


def save_index(lines: DataFrame, path: str) -> None:
    """The lexical index: lines by root, so that a pass over one root rewrites one folder."""
    lines.write.mode("overwrite").partitionBy("root_id").parquet(path)


def export(rows: DataFrame, path: str, form: str) -> None:
    """json rows, or markdown lines of column and value."""
    if form == "json":
        rows.write.mode("overwrite").json(path)
    elif form == "markdown":
        cells = F.concat_ws("\n", *[F.concat(F.lit(f"- **{c}**: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
        rows.select(F.concat(F.lit("## "), F.col(rows.columns[0]).cast("string"), F.lit("\n\n"), cells, F.lit("\n"))).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"no export form {form!r}")


def export_graph(nodes: DataFrame, edges: DataFrame, path: str, form: str) -> DataFrame:
    """Nodes (id, type, label) and edges (src, dst, kind) as graph-json lines or as the lists of graph-html pages; returns the manifest: form, n_nodes, n_edges."""
    if form == "graph-json":
        n = nodes.select(F.to_json(F.struct(F.lit("node").alias("what"), "id", "type", "label")).alias("line"))
        e = edges.select(F.to_json(F.struct(F.lit("edge").alias("what"), "src", "dst", "kind")).alias("line"))
    elif form == "graph-html":
        safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        n = nodes.select(F.concat(F.lit('<li class="'), safe("type"), F.lit('">'), safe("label"), F.lit("</li>")).alias("line"))
        e = edges.select(F.concat(F.lit('<li class="edge">'), safe("src"), F.lit(" "), safe("kind"), F.lit(" "), safe("dst"), F.lit("</li>")).alias("line"))
    else:
        raise ValueError(f"no export form {form!r}")
    n.unionByName(e).write.mode("overwrite").text(path)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges"))).select(F.lit(form).alias("form"), "n_nodes", "n_edges")


def ignored(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether ignore patterns leave a path out: the last that fits decides, ``!`` takes back, a slash inside binds to the root, one at the end means folders."""
    out = F.lit(False)
    for raw in patterns:
        p = raw.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        body = text.glob_to_regex(p.strip("/"))[1:-1]
        fits = path.rlike(("^" if "/" in p.rstrip("/") else "(^|/)") + body + ("/" if p.endswith("/") else "(/|$)"))
        out = F.when(fits, F.lit(not back)).otherwise(out)
    return out
