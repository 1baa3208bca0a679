"""Text and path functions over words and paths of the tables, with SQL that derives the answer by the same rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources import files as sources
from ..sources.views import Views
from .registry import query

BLANKS = "[ \\t\\n\\r]+"
WORDS = f"w AS (SELECT DISTINCT unnest(string_split_regex(text, '{BLANKS}')) AS word FROM documents)"
PATHS = """p AS (SELECT page_id, ltrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') || CASE page_id % 4 WHEN 0 THEN '/m_test.go' WHEN 1 THEN '/M' || page_id || '.rs' WHEN 2 THEN '/tests/m.tsx' ELSE '' END AS path FROM pages)"""


def _words(v: Views) -> DataFrame:
    return v.table("documents").select(F.explode(F.split("text", BLANKS)).alias("word")).distinct()


def _paths(v: Views) -> DataFrame:
    """Paths of urls, some with a file of a language behind."""
    tail = F.when(F.col("page_id") % 4 == 0, "/m_test.go").when(F.col("page_id") % 4 == 1, F.concat(F.lit("/M"), "page_id", F.lit(".rs"))).when(F.col("page_id") % 4 == 2, "/tests/m.tsx").otherwise("")
    return v.table("pages").select("page_id", F.concat(F.ltrim(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")), tail).alias("path"))


@query(rf"""WITH {WORDS} SELECT word, regexp_matches(word, '[_\-/.]|::') OR (regexp_matches(word, '[a-z]') AND regexp_matches(word, '[A-Z]') AND NOT regexp_matches(word, '^[A-Z][a-z]+$')) OR regexp_matches(word, '^[A-Z][A-Z0-9]+$') AS shaped FROM w""")
def shaped_words(v: Views) -> DataFrame:
    return _words(v).select("word", text.code_shaped(F.col("word")).alias("shaped"))


@query(f"""WITH {WORDS}, k AS (SELECT word, length(word) AS n FROM w WHERE regexp_matches(word, '^[a-z]+$')),
s AS (SELECT *, CASE WHEN n > 4 AND ends_with(word, 'ies') THEN substr(word, 1, n - 3) || 'y' WHEN n > 3 AND ends_with(word, 's') AND NOT ends_with(word, 'ss') THEN substr(word, 1, n - 1) ELSE word END AS singular FROM k)
SELECT word, singular, CASE WHEN n > 6 AND ends_with(word, 'ing') THEN substr(word, 1, n - 3) WHEN n > 5 AND ends_with(word, 'ed') THEN substr(word, 1, n - 2) ELSE singular END AS stem,
CASE WHEN n < 3 OR ends_with(word, 's') THEN word WHEN regexp_matches(word, '[^aeiou]y$') THEN substr(word, 1, n - 1) || 'ies' WHEN regexp_matches(word, '(x|ch|sh)$') THEN word || 'es' ELSE word || 's' END AS plural FROM s""")
def word_forms(v: Views) -> DataFrame:
    w = F.col("word")
    return _words(v).where(w.rlike("^[a-z]+$")).select("word", text.singular(w).alias("singular"), text.light_stem(w).alias("stem"), text.plural(w).alias("plural"))


@query(f"""WITH {PATHS}, e AS (SELECT *, lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_extract(path, '([^/]*)$', 1) AS name FROM p)
SELECT page_id, CASE ext WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'tsx' THEN 'tsx' END AS language, regexp_matches(path, '(^|/)(tests|__tests__)(/|$)') OR name = 'tests.rs' OR regexp_matches(name, '^test_|_tests?\\.|\\.test\\.|\\.spec\\.') AS test,
path = 'en' OR starts_with(path, 'en/') AS inside FROM e""")
def url_path_classes(v: Views) -> DataFrame:
    p = F.col("path")
    return _paths(v).select("page_id", text.language_of(p).alias("language"), text.is_test_path(p).alias("test"), text.within_root(p, "en").alias("inside"))


@query(f"""WITH {PATHS} SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)fr/') THEN true WHEN regexp_matches(path, '(^|/)[^/]*5\\.html(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*\\.html(/|$)') THEN true
WHEN regexp_matches(path, '^en/[0-9][^/]*7(/|$)') THEN true ELSE false END AS ignored FROM p""")
def ignored_urls(v: Views) -> DataFrame:
    return _paths(v).select("page_id", sources.ignored(F.col("path"), ("# numbers", "/en/[0-9]*7", "*.html", "!*5.html", "fr/")).alias("ignored"))
