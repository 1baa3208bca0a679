"""Markdown notes as columns: front matter, titles, summaries, sections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRONT = r"(?s)^\n*---\r?\n(.*?)\n---"


def front_block(text: Column) -> Column:
    """What stands between the first two lines of ---, empty if nothing does."""
    return F.regexp_extract(text, _FRONT, 1)


def body(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, _FRONT + r"\n*", "")


def front_scalar(text: Column, key: str) -> Column:
    """A value of the front matter without its quotes; null if there is none."""
    value = F.regexp_extract(front_block(text), rf"(?m)^[ \t]*{key}:[ \t]*([^\n]*?)[ \t\r]*$", 1)
    return F.nullif(F.regexp_replace(value, "^[\"']+|[\"']+$", ""), F.lit(""))


def front_list(text: Column, key: str) -> Column:
    """A list of the front matter, ``key: [a, b]`` or lines of ``- a`` after ``key:``."""
    block = F.concat(front_block(text), F.lit("\n"))
    inline = F.regexp_extract(block, rf"(?m)^[ \t]*{key}:[ \t]*\[([^\]\n]*)\]", 1)
    lines = F.regexp_extract(block, rf"(?m)^[ \t]*{key}:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*\n)+)", 1)
    clean = lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", "")
    parts = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(lines, F.lit(r"(?m)^[ \t]*-[ \t]+([^\n]*)$"), F.lit(1)))
    return F.filter(F.transform(parts, clean), lambda x: x != "")


def title(text: Column, path: Column) -> Column:
    """The title of the front matter, else the first heading, else the file's name."""
    heading = F.nullif(F.regexp_extract(body(text), r"(?m)^#[ \t]+(.+?)[ \t\r]*$", 1), F.lit(""))
    return F.coalesce(front_scalar(text, "title"), heading, F.element_at(F.split(path, "/"), -1))


def summary(text: Column) -> Column:
    """The first paragraph that isn't a heading, on one line; null if there is none."""
    paragraphs = F.filter(F.transform(F.split(body(text), r"\n[ \t]*\n"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"(?m)^#[^\n]*$", ""), r"\s+", " "))), lambda p: p != "")
    return F.get(paragraphs, 0)


def section(text: Column, heading: str) -> Column:
    """What stands under a ``## heading`` up to the next one; null if that is nothing."""
    found = F.regexp_extract(F.concat(F.lit("\n"), body(text)), rf"(?s)\n## {heading}\n(.*?)(?:\n## |$)", 1)
    return F.nullif(F.btrim(found, F.lit(" \t\r\n")), F.lit(""))


def decision(text: Column) -> Column:
    """The section Decision, else Context, else the whole body; null if empty."""
    return F.coalesce(section(text, "Decision"), section(text, "Context"), F.nullif(F.btrim(body(text), F.lit(" \t\r\n")), F.lit("")))
