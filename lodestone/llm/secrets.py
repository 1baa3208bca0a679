"""Secret scans with corpus-wide ownership frequency."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, read, text_of

#: Kinds in the order that breaks ties of start; the last one holds what the method adds.
KINDS = ("assign", "access", "hex", "owner")
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PLACEHOLDER = re.compile(r"example|sample|dummy|changeme|placeholder|xxxx|1234|abcd", re.IGNORECASE | re.ASCII)

_SPANS = "array<struct<kind:int,start:int,end:int,key:string,live:boolean>>"


def _live(value: str, distinct: int) -> bool:
    return len(set(value)) >= distinct and not PLACEHOLDER.search(value)


def scan_text(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) of one text, by start and kind; kind 3 are candidates outside all others."""
    found = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    taken = sorted((s, e) for _, s, e, _ in found)
    ends = list(accumulate((e for _, e in taken), max))  # of all spans up to each
    for m in GENERIC.finditer(text):
        v, before = m[0], bisect_left(taken, (m.end(),))  # spans that start before it ends
        if re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v) and not (before and ends[before - 1] > m.start()):
            found.append((3, m.start(), m.end(), v))
    return sorted(found, key=lambda x: (x[1], x[0]))


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        spans = [
            [{"kind": k, "start": s, "end": e, "key": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()[:32], "live": _live(v, 10 if k == 3 else 6)} for k, s, e, v in scan_text(t)] for t in b.pop("text")
        ]
        yield b.assign(spans=spans)


def candidate_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """row, doc_id, text_md5, owner, repository, spans of every row, as a durable table; row numbers its rows."""
    seen = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in repository_cols])
    given = docs.select(F.col(id_col).alias("doc_id"), F.md5(text_of(text_col)).alias("text_md5"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\x00")).alias("owner"), seen.alias("repository"), text_of(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = given.mapInPandas(_scan, f"doc_id {kind}, text_md5 string, owner string, repository string, spans {_SPANS}")
    return durable(out.select(F.monotonically_increasing_id().alias("row"), "*"), "secret-spans")


def ownership(found: DataFrame) -> DataFrame:
    """key, n_owners, n_repositories: in how many distinct ones each candidate occurs.

    Repeats within one owner and repository are folded before the first shuffle, so a
    candidate that a third of all rows carry arrives as a few rows.
    """
    once = found.select("owner", "repository", F.explode("spans.key").alias("key")).groupBy("key", "owner", "repository").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("key", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("key").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def judged_spans(found: DataFrame, min_copied_owners: int = 3, min_spread: int = 10) -> DataFrame:
    """row, kind, start, end, n_owners, n_repositories, copied, specific of each candidate.

    copied: at least ``min_copied_owners`` owners have it, so it's an example of some manual.
    specific: one owner has it, in fewer than ``min_spread`` repositories, and it looks live; what
    stands in more is the owner's boilerplate.
    """
    each = found.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    joined = each.join(ownership(found), "key")
    return joined.select("row", "kind", "start", "end", "n_owners", "n_repositories", (F.col("n_owners") >= min_copied_owners).alias("copied"), ((F.col("n_owners") == 1) & (F.col("n_repositories") < min_spread) & F.col("live")).alias("specific"))


def _listed(spans: Column) -> Column:
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, min_copied_owners: int = 3, min_spread: int = 10, **columns) -> DataFrame:
    """Spans of secrets of every row, and which of them the corpus shows to be examples or an owner's own.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_specific,
    span_owners, span_repositories.  The spans are those of the base patterns, and long mixed tokens
    (kind ``owner``) that look live and that one owner alone has, in fewer than ``min_spread``
    repositories.  The last two have the number of owners and repositories of each span.

    Nulls: a null text is empty and has no spans; null owners count as one owner.  Rows are
    judged one by one, so repeated rows come out alike, and repeats of one owner don't make a
    secret common.  Base spans of different kinds may overlap; ties of start go by kind.  An
    empty table gives no rows.  Columns but those named aren't read.
    """
    found = candidate_spans(docs, **columns)
    judged = judged_spans(found, min_copied_owners, min_spread).groupBy("row").agg(
        F.count_if("copied").alias("n_copied"),
        F.count_if("specific").alias("n_specific"),
        F.sort_array(F.collect_list(F.when((F.col("kind") < 3) | F.col("specific"), F.struct("start", "kind", "end", "n_owners", "n_repositories")))).alias("all"),
    )
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(judged, "row", "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), F.coalesce(_listed(F.col("all")), F.lit("")).alias("spans"), zero("n_copied"), zero("n_specific"), *[F.coalesce(F.transform("all", lambda x: x[c]), F.array().cast("array<long>")).alias(name) for c, name in (("n_owners", "span_owners"), ("n_repositories", "span_repositories"))]
    )


def _blank(spans: pd.Series, texts: pd.Series) -> pd.Series:
    def one(cuts, text):
        if cuts is None:
            return text
        out, at = [], 0
        for x in sorted(cuts, key=lambda x: (x["start"], x["end"])):
            if x["end"] > at:
                out += [text[at : max(at, x["start"])], "[SECRET]" * (x["start"] >= at)]
                at = x["end"]
        return "".join([*out, text[at:]])

    return pd.Series([one(c, t) for c, t in zip(spans, texts)], dtype=object)


def mask_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_copied_owners: int = 3, min_spread: int = 10, **columns) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]`` but widely copied examples; all rows and columns stay.

    Overlapping spans are replaced together.  Null texts stay null.  Nulls, repeated rows and
    empty tables as in ``find_secrets``.
    """
    found = candidate_spans(docs, id_col=id_col, text_col=text_col, **columns)
    cuts = judged_spans(found, min_copied_owners, min_spread).where("NOT copied AND (kind < 3 OR specific)").join(found.select("row", "doc_id", "text_md5"), "row")
    cuts = cuts.groupBy(F.col("doc_id").alias("__cut_id"), F.col("text_md5").alias("__cut_md5")).agg(F.collect_set(F.struct("start", "end")).alias("__cuts"))
    blank = F.pandas_udf(_blank, "string")
    held = docs.join(cuts, docs[id_col].eqNullSafe(F.col("__cut_id")) & (F.md5(docs[text_col]) == F.col("__cut_md5")), "left")
    return held.select(*[F.when(F.col("__cuts").isNotNull(), blank("__cuts", text_col)).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(read(spark, sf_dir, "documents"))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select(*[listed(c) if c in ("span_owners", "span_repositories") else F.col(c) for c in found.columns])


OP1_SQL = r"""
WITH k(kind, name, pattern) AS (VALUES
  (0, 'assign', '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'owner', '[A-Za-z0-9+/_=-]{20,}')),
d AS (SELECT doc_id, coalesce(text, '') AS t, source AS owner, coalesce(source, '') || chr(1) || coalesce(lang, '') AS repository FROM documents),
m AS (SELECT doc_id, t, owner, repository, kind, name, regexp_extract_all(t, pattern) AS hit, string_split_regex(t, pattern) AS gap FROM d, k),
p AS (SELECT doc_id, owner, repository, kind, name, unnest(hit) AS hit, unnest(gap[:len(hit)]) AS gap, generate_subscripts(hit, 1) AS i FROM m WHERE len(hit) > 0),
o AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i)::BIGINT AS stop FROM p),
v AS (SELECT doc_id, owner, repository, kind, name, stop - length(hit) AS start, stop,
             CASE WHEN kind = 0 THEN regexp_extract(hit, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1) ELSE hit END AS value FROM o),
a AS (SELECT * FROM v WHERE kind < 3 AND length(value) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
g AS (SELECT v.* FROM v WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')
      AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = v.doc_id AND a.start < v.stop AND a.stop > v.start)),
f AS (SELECT * FROM a UNION ALL SELECT * FROM g),
w AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS n_owners, count(DISTINCT repository) AS n_repositories FROM f GROUP BY value),
j AS (SELECT f.*, n_owners, n_repositories, n_owners >= 3 AS copied,
             n_owners = 1 AND n_repositories < 10 AND len(list_distinct(string_split(value, ''))) >= CASE kind WHEN 3 THEN 10 ELSE 6 END
             AND NOT regexp_matches(lower(value), 'example|sample|dummy|changeme|placeholder|xxxx|1234|abcd') AS specific FROM f JOIN w USING (value)),
s AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
             string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind < 3 OR specific) AS spans,
             string_agg(n_owners::VARCHAR, ',' ORDER BY start, kind) FILTER (kind < 3 OR specific) AS span_owners,
             string_agg(n_repositories::VARCHAR, ',' ORDER BY start, kind) FILTER (kind < 3 OR specific) AS span_repositories,
             count(*) FILTER (copied) AS n_copied, count(*) FILTER (specific) AS n_specific FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(n_specific, 0)::BIGINT AS n_specific, coalesce(span_owners, '') AS span_owners, coalesce(span_repositories, '') AS span_repositories
FROM d LEFT JOIN s USING (doc_id)
"""
