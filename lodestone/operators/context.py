"""Answers made of several reads: staged search, docs, slices of sources, packs within a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routing, sets, text
from ..sources.scratch import held
from .budget import knapsack
from .graph import distances
from .postings import candidate_files, lines_of, verified
from .search import grouped, lexical


def search_rows(lines: DataFrame, pattern: str, mode: str = "default", limit: int = 50) -> DataFrame:
    """Matches as lines (``default``), as previews by file (``compact``), or as files with the place of the first match (``cards``)."""
    found = lexical(lines, pattern)
    if mode == "compact":
        return grouped(found).orderBy("root_id", "path").limit(limit)
    if mode == "cards":
        return found.groupBy("root_id", "path").agg(F.min("line_number").alias("line_number"), F.count("*").alias("n_matches")).orderBy("root_id", "path").limit(limit)
    return found.orderBy("root_id", "path", "line_number").limit(limit)


def with_path_matches(query: str, files: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """``items`` (root_id, path, place) behind the files whose path the query is; one row a file, up to ``limit``."""
    direct = files.where(F.col("path") == query.strip().removeprefix("./")).select("root_id", "path", F.lit(-1).cast("long").alias("place"))
    both = direct.unionByName(items.select("root_id", "path", F.col("place").cast("long").alias("place")))
    return both.groupBy("root_id", "path").agg(F.min("place").alias("place")).orderBy("place", "root_id", "path").limit(limit)


def staged_find(lines: DataFrame, index: DataFrame, tasks: DataFrame, limit: int = 20, most_attempts: int = 24, most_rows: int = 50) -> DataFrame:
    """task, attempt, path of each task's (task, text) first attempt that finds anything, and of those after it until ``limit`` files are found.

    The task's own text comes first; its phrases and words (``text.phrases``) follow only if it finds nothing.
    ``index`` has the postings (gram, file) of the lines' files.  Attempts that read alike are looked for once,
    first those of all tasks' own texts, then those of the tasks left over; ``most_rows`` lines count of each.
    """
    tokens = text.query_tokens(F.col("text"))
    asked = tasks.select("task", F.slice(F.concat(F.array(F.lower(F.trim("text"))), text.phrases(tokens), tokens), 1, most_attempts).alias("all"))
    attempts = held(asked.select("task", F.posexplode("all").alias("attempt", "needle")).where("needle != ''"), "attempts")

    candidates = held(candidate_files(index, attempts.select("needle"), ignore_case=True), "candidates")

    lines = lines_of(lines, index)

    def found(some: DataFrame) -> DataFrame:
        hits = verified(lines, held(candidates.join(some.select("needle").distinct(), "needle"), "candidates"), ignore_case=True).select("needle", "root_id", "path", "line_number")
        kept = hits.select("needle", "path", F.row_number().over(Window.partitionBy("needle").orderBy("root_id", "path", "line_number")).alias("n")).where(F.col("n") <= most_rows)
        return some.join(kept.select("needle", "path").distinct(), "needle").groupBy("task", "path").agg(F.min("attempt").alias("attempt"))

    own = held(found(attempts.where("attempt = 0")), "found-at-once")
    left = attempts.where("attempt > 0").join(own.select("task").distinct(), "task", "left_anti")
    files = held(found(left), "found-later")
    before = F.sum("new").over(Window.partitionBy("task").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1))
    per = files.groupBy("task", "attempt").agg(F.count("*").alias("new")).select("task", "attempt", F.coalesce(before, F.lit(0)).alias("before"))
    return own.select("task", "attempt", "path").unionByName(files.join(per.where(F.col("before") < limit).select("task", "attempt"), ["task", "attempt"]).select("task", "attempt", "path"))


def docs_search(notes: DataFrame, current: DataFrame, term: str, limit: int = 20) -> DataFrame:
    """note, path, freshness of the notes (note, path, hash, body) that hold a term, by note; freshness by the current hash (path, now).

    Four times as many are met, 20 to 200, since those whose source is gone are left out.
    """
    met = notes.where(F.lower("body").contains(term.lower())).orderBy("note").limit(max(20, min(4 * limit, 200)))
    j = met.join(current, "path", "left").where("now IS NOT NULL")
    return j.select("note", "path", F.when(F.col("hash").isNull(), "invalid").when(F.col("hash") == F.col("now"), "fresh").otherwise("stale").alias("freshness")).orderBy("note").limit(limit)


def commentary_scan(notes: DataFrame, current: DataFrame) -> DataFrame:
    """total, stale: the notes (path, hash) whose source changed or is gone (path, now) count as stale."""
    j = notes.select("path", "hash").join(current.select("path", "now"), "path", "left")
    return j.agg(F.count("*").alias("total"), F.count_if(~F.coalesce(F.col("hash") == F.col("now"), F.lit(False))).alias("stale"))


def semantic_candidates(vectors: DataFrame, edges: DataFrame, concept: str, query: list[float], threshold: float = 0.2, top: int = 20, cutoff: int = 2) -> DataFrame:
    """id, score, distance of the ``top`` vectors (id, v) nearest to a concept's that reach ``threshold`` and can be reached from it in ``cutoff`` steps."""
    q = F.array(*[F.lit(float(x)) for x in query])
    best = vectors.select("id", F.round(sets.cosine(F.col("v"), q), 6).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(top)
    return best.join(distances(edges, concept, cutoff), "id").select("id", "score", "distance")


def union_for_unmatched(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """Exact links (concept, symbol), and semantic ones of concepts that have no exact one."""
    rest = semantic.join(exact.select("concept").distinct(), "concept", "left_anti")
    return exact.select("concept", "symbol", F.lit("exact").alias("source")).unionByName(rest.select("concept", "symbol", F.lit("semantic").alias("source")))


def promoted(candidates: DataFrame, most: int = 3) -> DataFrame:
    """task, path of each task's best candidates (task, path, definition_hits, query_hits, name_hits, primary_hits, command_hits, dynamic_hits, best_rank, first_seen), at most ``most``.

    Sources first, then more definitions, a hit of the primary term, names, commands, the score of ``find_rank`` and hits, then the better and earlier query.  Archived proposals go if
    a task has a live source.
    """
    rank, archived = routing.source_rank(F.col("path")), F.col("path").rlike("(^|/)openspec/changes/archive/")
    w = Window.partitionBy("task")
    c = candidates.select("*", rank.alias("rank"), archived.alias("archived")).select("*", F.max((F.col("rank") >= 2) & ~F.col("archived")).over(w).alias("live")).where("NOT (live AND archived)")
    score = F.col("query_hits") * 20 - F.when(text.is_test_path(F.col("path")), 15).otherwise(0) + F.when(F.col("path").startswith("src/"), 5).otherwise(0)
    primary = F.least(F.col("primary_hits"), F.lit(1))
    order = [F.desc("rank"), F.desc("definition_hits"), primary.desc(), F.desc("name_hits"), F.desc("command_hits"), F.desc("dynamic_hits"), score.desc(), F.desc("query_hits"), F.col("best_rank"), F.col("first_seen"), F.col("path")]
    return c.select("task", "path", F.row_number().over(w.orderBy(*order)).alias("place")).where(F.col("place") <= most)


def source_slices(files: DataFrame, spans: DataFrame, margin: int = 2) -> DataFrame:
    """path, first, last, source: the lines of spans (path, first, last, hash) with ``margin`` lines about them, those that touch as one, numbered.

    Spans of a file (path, content, content_hash) that has changed since are left out.
    """
    same = spans.join(files.select("path", "content_hash"), "path").where(F.col("hash") == F.col("content_hash"))
    wide = same.select("path", F.greatest(F.col("first") - margin, F.lit(1)).alias("first"), (F.col("last") + margin).alias("last"))
    w = Window.partitionBy("path").orderBy("first", "last")
    cut = wide.select("*", F.coalesce(F.col("first") > F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("int").alias("new"))
    island = cut.select("*", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island")).groupBy("path", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    body = island.join(files.select("path", F.split("content", "\n").alias("lines")), "path").withColumn("last", F.least("last", F.size("lines")))
    numbered = F.transform(F.slice("lines", F.col("first"), F.greatest(F.col("last") - F.col("first") + 1, F.lit(0))), lambda x, i: F.concat_ws(": ", (F.col("first") + i).cast("string"), x))
    return body.where("first <= last").select("path", "first", "last", F.array_join(numbered, "\n").alias("source"))


def context_pack(parts: list[tuple[str, DataFrame]], budget: int, most: int = 10) -> DataFrame:
    """request, spent, kept: what fits of each request's artifacts (request, name, cost), by the order of their kinds; those that don't fit are passed over.

    A request has at most ``most`` artifacts.
    """
    all_ = reduce(DataFrame.unionByName, [df.select("request", F.struct(F.lit(i).alias("kind"), F.col("name")).alias("item"), "cost") for i, (_, df) in enumerate(parts)])
    few = all_.select("*", F.row_number().over(Window.partitionBy("request").orderBy("item")).alias("n")).where(F.col("n") <= most)
    names = F.array(*[F.lit(k) for k, _ in parts])
    k = knapsack(few, "request", "item", "cost", budget)
    return k.select("request", "spent", F.array_join(F.transform("kept", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["name"])), ",").alias("kept"))


def ask_packets(asks: DataFrame, evidence: DataFrame, most: int = 20, by: str = "ask") -> DataFrame:
    """ask, recipe, n_evidence, evidence of each question (ask, text): the recipe that its words call for and the first items (ask, item, score).

    Where questions share their evidence, ``by`` is a column of both that names what they share: items are ranked once for all its questions.
    """
    ranked = evidence.select(by, "item", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "item")).alias("place")).where(F.col("place") <= most)
    listed = ranked.groupBy(by).agg(F.count("*").alias("n_evidence"), F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("evidence"))
    j = asks.select(*dict.fromkeys((by, "ask")), routing.recipe(F.col("text")).alias("recipe"))
    return j.join(listed, by, "left").select("ask", "recipe", F.coalesce("n_evidence", F.lit(0).cast("long")).alias("n_evidence"), F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence"))
