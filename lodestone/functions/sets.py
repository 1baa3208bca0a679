"""Similarities of sets and vectors, as columns.  The three treat empty sets differently, on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_ratio(a, b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Both empty: 0; one empty: 1."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - _ratio(a, b))


def sample_similarity(a: Column, b: Column) -> Column:
    """Any empty: 0."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(_ratio(a, b))


def shingles(content: Column, width: int = 32) -> Column:
    """All non-overlapping shingles of a text, in order; what is left at its end is no shingle."""
    return F.regexp_extract_all(content, F.lit(f"(?s).{{{width}}}"), F.lit(0))


def sampled_shingles(content: Column, width: int = 32, window: int = 4096, cap: int = 256 * 1024) -> Column:
    """Hashes of the non-overlapping shingles of the first, the middle and the last window of a text."""
    n = F.length(content)
    none = F.array().cast("array<string>")

    def within(start: Column) -> Column:  # one pass over the window, where a substring for each shingle would begin anew
        return F.transform(F.regexp_extract_all(F.substring(content, start + 1, F.lit(window)), F.lit(f"(?s).{{{width}}}"), F.lit(0)), F.md5)

    last = F.greatest(n - window, F.lit(0))
    middle = F.least(F.greatest(F.floor(n / 2).cast("int") - window // 2, F.lit(0)), last)
    some = F.array_sort(F.array_distinct(F.concat(within(F.lit(0)), F.when(n > window, within(middle)).otherwise(none), F.when(n > window, within(last)).otherwise(none))))
    return F.when((n > cap) | (n < width), none).otherwise(some)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is next to nothing."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-10) | (nb < 1e-10), 0.0).otherwise(dot(a, b) / (na * nb))
