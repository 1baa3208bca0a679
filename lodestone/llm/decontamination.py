"""Benchmark decontamination by a distributed positional inverted index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, read, text_of

#: What separates words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text with A-Z lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before letters are lower-cased.
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How many of a window's rarest terms are looked up in the index.
RAREST = 3
#: Test vocabularies of at most so many terms are broadcast to thin out words before they are counted.
FEW_TERMS = 200_000
#: Parts that the postings of a term are dealt into by document.
PARTS = 16


def plain_words(text: Column) -> Column:
    """The words of a text that isn't null, in order.  Letters beyond A-Z keep their case."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    first = lambda a: (a[0] == "").cast("int")
    return let(F.split(low, BETWEEN), lambda a: F.slice(a, first(a) + 1, F.greatest(F.size(a) - first(a) - (F.element_at(a, -1) == "").cast("int"), F.lit(0))))


def n_plain_words(text: Column) -> Column:
    return let(F.split(text, BETWEEN_ANY), lambda a: F.greatest(F.size(a) - (a[0] == "").cast("int") - (F.element_at(a, -1) == "").cast("int"), F.lit(0))).cast("long")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text of each row; doc tells rows apart that share an id but not a text, and takes null ids."""
    text = text_of(text_col)
    return docs.select(F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash")).alias("doc"), text.alias("text"))


def keyed_words(texts: DataFrame) -> DataFrame:
    return texts.select("doc", plain_words(F.col("text")).alias("words"))


def test_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(win, words) of the distinct windows, and (win, item_id); short items are one window, empty ones none."""
    one = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0))), lambda i: F.slice(w, i + 1, size))
    each = items.select(F.col(id_col).cast("string").alias("item_id"), plain_words(text_of(text_col)).alias("w")).where("size(w) > 0")
    each = durable(each.select("item_id", F.explode(one(F.col("w"))).alias("words")).distinct(), "windows-items")
    windows = durable(each.select("words").distinct().select(F.monotonically_increasing_id().alias("win"), "words"), "windows")
    return windows, each.join(windows, "words").select("win", "item_id")


def rarest_terms(words: DataFrame, windows: DataFrame, rarest: int = RAREST) -> tuple[DataFrame, bool]:
    """(win, n, terms), few: each window's length and its rarest terms as (count, offset, term), rarest first; and whether the test vocabulary has FEW_TERMS terms at most.

    Counts are over the whole corpus, summed before they are shuffled; a vocabulary of
    few terms thins out the words before.  A window with a term that the corpus lacks
    can't occur and is left out.
    """
    asked = durable(windows.select(F.explode("words").alias("term")).distinct(), "windows-terms")
    each = words.select(F.explode("words").alias("term"))
    few = asked.count() <= FEW_TERMS
    counts = (each.join(F.broadcast(asked), "term", "left_semi") if few else each).groupBy("term").agg(F.count("*").alias("count"))
    counts = counts if few else counts.join(asked, "term", "left_semi")
    terms = windows.select("win", F.size("words").alias("n"), F.posexplode("words").alias("at", "term")).groupBy("win", "n", "term").agg(F.min("at").alias("offset"))
    found = terms.join(counts, "term", "left").groupBy("win", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "offset", "term"))).alias("terms"))
    return durable(found.where(F.col("terms")[0]["count"] > 0).select("win", "n", F.slice("terms", 1, rarest).alias("terms")), "windows-rarest"), few


def _part(doc: Column) -> Column:
    """The part of a term's postings that those of a document are in."""
    return F.pmod(F.xxhash64(doc, F.lit(17)), F.lit(PARTS))


def _parts() -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part")


def postings(words: DataFrame, terms: DataFrame, few: bool) -> DataFrame:
    """The index: term, part, doc, pos of every occurrence of ``terms`` (term) in the corpus, as a table.

    Few terms are broadcast, so no word is shuffled; else words meet them by term and part of
    the documents, so that no task has all postings of a frequent term.
    """
    each = words.select("doc", _part(F.col("doc")).alias("part"), F.posexplode("words").alias("pos", "term"))
    asked = terms.distinct()
    met = each.join(F.broadcast(asked), "term", "left_semi") if few else each.join(asked.select("term", _parts()), ["term", "part"])
    return durable(met.select("term", "part", "doc", "pos"), "postings")


def candidates(index: DataFrame, rare: DataFrame, slop: int) -> DataFrame:
    """doc, win, start, exact: where the lists of a window's rarest terms meet, shifted by their offsets.

    The list of the rarest term gives the starts.  The second list is met within ``slop``
    positions, through buckets of positions, so that no occurrence of a term is paired with
    all of another; ``exact`` rows meet it, and the lists after it, at the very position.
    """
    first = index.join(rare.select("win", "terms", F.col("terms")[0]["term"].alias("term"), _parts()), ["term", "part"]).select("doc", "win", "terms", (F.col("pos") - F.col("terms")[0]["offset"]).alias("start")).where("start >= 0")
    alone = first.where(F.size("terms") == 1).select("doc", "win", "start", F.lit(True).alias("exact"))
    wide = slop + 1
    aim = first.where(F.size("terms") > 1).select("*", (F.col("start") + F.col("terms")[1]["offset"]).alias("aim"), F.col("terms")[1]["term"].alias("term"))
    aim = aim.select("*", F.explode(F.array(*[F.floor(F.col("aim") / wide) + k for k in (-1, 0, 1)])).alias("bucket"))
    near = aim.join(index.select("term", "doc", "pos", F.floor(F.col("pos") / wide).alias("bucket")), ["term", "doc", "bucket"]).where(F.abs(F.col("pos") - F.col("aim")) <= slop)
    met = near.groupBy("doc", "win", "start").agg(F.first("terms").alias("terms"), F.bool_or(F.col("pos") == F.col("aim")).alias("exact"))
    for k in range(2, RAREST):
        more = met.where(f"exact AND size(terms) > {k}").select("doc", "win", "start", F.col("terms")[k]["term"].alias("term"), (F.col("start") + F.col("terms")[k]["offset"]).alias("pos"))
        held = more.join(index, ["term", "doc", "pos"], "left_semi").select("doc", "win", "start", F.lit(True).alias("held")).distinct()
        met = met.join(held, ["doc", "win", "start"], "left").withColumn("exact", F.col("exact") & ((F.size("terms") <= k) | F.coalesce("held", F.lit(False)))).drop("held")
    return durable(met.select("doc", "win", "start", "exact").unionByName(alone).distinct(), "candidates")


def phrase_matches(texts: DataFrame, found: DataFrame, windows: DataFrame) -> DataFrame:
    """doc, matches: (start, n, win) of the candidates whose every word stands in the document (doc, text)."""
    asked = found.where("exact").join(windows, "win").groupBy("doc").agg(F.collect_list(F.struct("start", "win", F.col("words").alias("asked"))).alias("tried"))
    held = texts.join(asked, "doc").dropDuplicates(["doc"])
    right = let(plain_words(F.col("text")), lambda w: F.filter("tried", lambda c: F.slice(w, c["start"] + 1, F.size(c["asked"])) == c["asked"]))
    return held.select("doc", F.explode(right).alias("c")).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct(F.col("c.start").alias("start"), F.size("c.asked").alias("n"), F.col("c.win").alias("win")))).alias("matches"))


def covered(matches: Column) -> Column:
    """Words inside any of the sorted (start, n, ..)."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["start"] + x["n"]).alias("end"), (a["n"] + F.greatest(x["start"] + x["n"] - F.greatest(x["start"], a["end"]), F.lit(0))).alias("n"))
    return F.aggregate(matches, start, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, *, size: int = 10, slop: int = 5, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of each row.

    n_near counts the windows whose two rarest terms stand within ``slop`` positions of where
    the window has them.

    Nulls: a null text has no words, a null id is an id like others; an item with a null id
    counts as hit words but not as an item.  Texts without words have no hits and items
    without words no windows.  Items that share a window are all named; repeated rows get
    equal results, and rows that share an id are judged by their own text.  Empty tables give
    no rows or no hits.  Other columns aren't read.
    """
    texts = keyed_texts(docs, id_col, text_col)
    words = keyed_words(texts)
    windows, of_items = test_windows(items, size, item_id_col, item_text_col)
    rare, few = rarest_terms(words, windows)
    index = postings(words, rare.select(F.explode("terms.term").alias("term")), few)
    found = candidates(index, rare, slop)
    matched = durable(phrase_matches(texts, found, windows), "matches")
    named = matched.select("doc", F.explode(F.array_distinct("matches.win")).alias("win")).join(of_items, "win").groupBy("doc").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    near = found.groupBy("doc").agg(F.count_distinct("win").alias("n_near"))
    each = texts.select("doc", n_plain_words(F.col("text")).alias("n_words"))
    out = each.join(near, "doc", "left").join(matched, "doc", "left").join(named, "doc", "left")
    none = F.lit(0).cast("long")
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc.doc_id").alias("doc_id"), "n_words", F.coalesce(covered(F.col("matches")), none).alias("n_hit"), F.size(items_).cast("long").alias("n_items"), F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"), F.coalesce("n_near", none).alias("n_near")
    ).select("*", (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, *, size: int = 10) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) in which no window of ``items`` occurs, whole, with all columns whatever their names.

    Nulls: a null text has no words and stays, as empty texts do; a null id is an id like others.  Items without words
    have no windows.  Repeated rows stay or go alike, and rows that share an id are judged by their own text.  An empty
    table gives no rows, and without items all rows stay.
    """
    texts = keyed_texts(docs, "doc_id", "text")
    words = keyed_words(texts)
    windows, _ = test_windows(items, size)
    rare, few = rarest_terms(words, windows)
    found = candidates(postings(words, rare.select(F.explode("terms.term").alias("term")), few), rare, 0)
    hit = durable(phrase_matches(texts, found, windows).select(F.col("doc").alias("__hit")), "contaminated")
    key = F.struct(F.col("doc_id"), F.xxhash64(text_of("text")).alias("text_hash"))
    return docs.select(key.alias("__hit"), *[F.col(c) for c in docs.columns]).join(hit, "__hit", "left_anti").drop("__hit")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, list_slice(w, s + 1, s + least(10, len(w))) AS words FROM b, unnest(range(0, greatest(len(w) - 10, 0) + 1)) t(s) WHERE len(w) > 0),
win AS (SELECT row_number() OVER () AS win, words FROM (SELECT DISTINCT words FROM wi)),
p AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM d),
n AS (SELECT term, count(*) AS c FROM p GROUP BY term),
t AS (SELECT win, term, min(place) AS off FROM (SELECT win, unnest(words) AS term, generate_subscripts(words, 1) - 1 AS place FROM win) GROUP BY win, term),
r AS (SELECT win, t.term, off, row_number() OVER (PARTITION BY win ORDER BY coalesce(c, 0), off, t.term) AS k, min(coalesce(c, 0)) OVER (PARTITION BY win) AS least, count(*) OVER (PARTITION BY win) AS terms FROM t LEFT JOIN n USING (term)),
f AS (SELECT doc_id, win, pos - off AS start, terms FROM r JOIN p USING (term) WHERE k = 1 AND least > 0 AND pos >= off),
m AS (SELECT f.doc_id, f.win, f.start, len(words) AS size FROM f JOIN win USING (win) JOIN d USING (doc_id) WHERE list_slice(d.w, start + 1, start + len(words)) = words),
h AS (SELECT doc_id, count(DISTINCT start + i) AS n_hit FROM m, unnest(range(0, size)) u(i) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM m JOIN win USING (win) JOIN wi USING (words) GROUP BY doc_id),
a AS (SELECT doc_id, count(DISTINCT win) AS n_near FROM (
        SELECT f.doc_id, f.win FROM f JOIN r ON r.win = f.win AND r.k = 2 JOIN p ON p.doc_id = f.doc_id AND p.term = r.term AND abs(p.pos - f.start - r.off) <= 5
        UNION ALL SELECT doc_id, win FROM f WHERE terms = 1) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN a USING (doc_id)
"""
