"""Search over lines and vectors, and the fusion of both."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets, text

#: The constant of reciprocal rank fusion, and the offset of vector ranks in ties.
RRF_K, VECTOR_TIE = 60, 100


def lexical(lines: DataFrame, pattern: str, *, literal: bool = False, ignore_case: bool = False, path: str | None = None, types: tuple[str, ...] = (), not_types: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """Lines that hold ``pattern``, with the place of the first match, by (root, path, line); of files of the named languages, or of all but those."""
    line = F.lower("line") if literal and ignore_case else F.col("line")
    if literal:
        hit = line.contains(pattern.lower() if ignore_case else pattern)
        at = F.instr(line, pattern.lower() if ignore_case else pattern)
    else:
        p = ("(?i)" if ignore_case else "") + pattern
        hit, at = line.rlike(p), F.regexp_instr(line, F.lit(p))
    language = F.coalesce(text.language_of(F.col("path")), F.lit(""))
    typed = (language.isin(*types) if types else F.lit(True)) & (~language.isin(*not_types) if not_types else F.lit(True))
    found = lines.where(hit & text.path_matches(F.col("path"), path) & typed).select("root_id", "path", "line_number", "line", at.cast("int").alias("column"))
    return found.orderBy("root_id", "path", "line_number").limit(limit) if limit else found


def rooted(lines: DataFrame, pattern: str, primary: str, limit: int = 50) -> DataFrame:
    """Matches of the primary root first, then of others, up to ``limit``."""
    f = lexical(lines, pattern).withColumn("other", F.when(F.col("root_id") == primary, 0).otherwise(1))
    return f.orderBy("other", "root_id", "path", "line_number").limit(limit).drop("other")


def grouped(matches: DataFrame, per_file: int = 5) -> DataFrame:
    """Matches by file: their number, and previews of the first ones."""
    w = Window.partitionBy("root_id", "path").orderBy("line_number")
    m = matches.select("root_id", "path", F.row_number().over(w).alias("rn"), text.preview(F.col("line")).alias("p"))
    return m.groupBy("root_id", "path").agg(F.count("*").alias("n_matches"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= per_file, F.struct("rn", "p")))), lambda x: x["p"]), "\n").alias("previews"))


def find_rank(lines: DataFrame, terms: list[str], limit: int = 20) -> DataFrame:
    """Files by the number of terms and lines hit: 20 a hit, 15 less for tests, 5 more under src."""
    pieces = [F.when(F.lower("line").contains(t), 1).otherwise(0) for t in terms]
    hits = lines.where(F.lower("line").rlike("|".join(map(re.escape, terms)))).groupBy("path").agg(F.sum(sum(pieces)).alias("hits"))
    score = F.col("hits") * 20 - F.when(text.is_test_path(F.col("path")), 15).otherwise(0) + F.when(F.col("path").startswith("src/"), 5).otherwise(0)
    return hits.select("path", "hits", score.alias("score")).orderBy(F.desc("score"), "path").limit(limit)


def vector_topk(vectors: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """The k vectors (vec_id, v) nearest to a query by cosine; each partition keeps k."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select("vec_id", F.round(sets.cosine(F.col("v"), q), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(k)


def nearest_centroid(vectors: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Each vector's nearest mean of a label by cosine, null under ``threshold``; there are few labels."""
    long = vectors.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c")).withColumnRenamed("label", "route")
    table = means.agg(F.array_sort(F.collect_list(F.struct("route", "c"))).alias("all"))
    scored = vectors.join(F.broadcast(table)).select("vec_id", "label", F.transform("all", lambda m: F.struct(F.round(sets.cosine(F.col("v"), m["c"]), 6).alias("score"), (-m["route"]).alias("neg"))).alias("s")).select("vec_id", "label", F.array_max("s").alias("b"))
    return scored.select("vec_id", "label", F.when(F.col("b.score") >= threshold, -F.col("b.neg")).alias("route"), F.col("b.score").alias("score"))


def fuse(lexical_rank: DataFrame, vector_rank: DataFrame, *, by_document: bool = True, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two lists (doc, rank from 0).

    By document a row found by both has both shares; else the lists are only interleaved.
    Ties go by the best rank, where those of vectors stand behind.
    """
    one = lambda df, source, extra: df.select("doc", F.lit(source).alias("source"), (1 / (F.col("rank") + RRF_K + 1)).alias("share"), (F.col("rank") + extra).alias("best"))
    both = one(lexical_rank, "lexical", 0).unionByName(one(vector_rank, "vector", VECTOR_TIE))
    if by_document:
        both = both.groupBy("doc").agg(F.when(F.count("*") > 1, "hybrid").otherwise(F.min("source")).alias("source"), F.sum("share").alias("share"), F.min("best").alias("best"))
    return both.select("doc", "source", F.round("share", 6).alias("score"), "best").orderBy(F.desc("score"), "best", "doc", "source").limit(limit)


def containment(items: DataFrame, docs: DataFrame, anchor: int = 5, few: int = 1000) -> DataFrame:
    """(item_id, doc_id) of items whose whole text a document holds, as ``contains`` finds it.

    An item's first and last words may be parts of a document's words, as after a quote mark or
    before a comma; those between are whole.  Meets on the first ``anchor`` of these, then compares the texts.
    Items of fewer than three words have none: up to ``few`` of them are compared with all documents, more meet them by their grams.  Blank ones are left out.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    all_words = items.where(F.trim("text") != "").select("item_id", "text", words(F.col("text")).alias("w"))
    inner = all_words.where(F.size("w") >= 3).select("item_id", "text", F.slice("w", F.lit(2), F.greatest(F.least(F.size("w") - 2, F.lit(anchor)), F.lit(0))).alias("run"))
    bodies = docs.select("doc_id", F.col("text").alias("body"))
    lengths = sorted(r[0] for r in inner.select(F.size("run").alias("n")).distinct().collect())  # at most ``anchor`` numbers
    w = F.col("w")
    found = bodies.limit(0).select("doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.col("body").alias("text"))
    if lengths:
        starts = lambda n: F.when(F.size(w) >= n + 2, F.transform(F.sequence(F.lit(2), F.greatest(F.size(w) - n, F.lit(2))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
        runs = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(*map(starts, lengths)))).alias("run"))
        found = runs.join(inner.select("item_id", "text", F.array_join("run", " ").alias("run")), "run").select("doc_id", "item_id", "text")
    brief = all_words.where(F.size("w") < 3).select("item_id", "text")
    if brief.limit(few + 1).count() <= few:
        short = bodies.join(F.broadcast(brief), F.col("body").contains(F.col("text")))
    else:
        from ..sources.scratch import held
        from .postings import candidate_files, in_slots, lines_of, postings  # which search by the functions of this module

        named = bodies.select(F.lit("").alias("root_id"), F.col("doc_id").cast("string").alias("path"), "doc_id", "body")
        index = held(postings(named.select("root_id", "path", F.translate("body", "\n", " ").alias("content"))), "postings")
        near = candidate_files(index, brief.select(F.translate("text", "\n", " ").alias("needle")))
        met = held(near.join(brief.withColumn("needle", F.translate("text", "\n", " ")), "needle"), "candidates")
        short = in_slots(lines_of(named, index), met).where(F.col("body").contains(F.col("text")))
    return found.join(bodies, "doc_id").where(F.col("body").contains(F.col("text"))).select("item_id", "doc_id").unionByName(short.select("item_id", "doc_id")).distinct()


def hit_at_k(results: DataFrame, expected: DataFrame, k: int = 5) -> DataFrame:
    """n_tasks, hit_rate: tasks that have an expected document (task, doc) among the first k results (task, doc, rank from 0)."""
    hit = expected.join(results.where(F.col("rank") < k).select("task", "doc", F.lit(1).alias("hit")), ["task", "doc"], "left").groupBy("task").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return hit.agg(F.count("*").alias("n_tasks"), F.round(F.avg("hit"), 6).alias("hit_rate"))


def wrong_context_rate(returned: DataFrame, allowed: DataFrame) -> DataFrame:
    """task, rate: the share of returned (task, doc) that isn't allowed; null for tasks without a list."""
    lists = allowed.select("task").distinct().withColumn("listed", F.lit(True))
    j = returned.join(allowed.select("task", "doc", F.lit(1).alias("ok")), ["task", "doc"], "left").join(lists, "task", "left")
    return j.groupBy("task").agg(F.when(F.bool_or(F.coalesce("listed", F.lit(False))), F.round(1 - F.count("ok") / F.count("*"), 6)).alias("rate"))
