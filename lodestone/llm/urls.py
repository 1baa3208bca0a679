"""URL filters: explicit rules, and beyond them a tree of path templates judged by labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, read

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

_SPLIT = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both are empty if the url is null or has no ``://``."""
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, _SPLIT, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(u, _SPLIT, 2)


def longest_rule(rules: tuple[tuple[str, str, str], ...], host: Column, path: Column) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """The path's segments, those that vary by their form as that form."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    end = lambda s: F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    form = lambda s: (
        F.when(s.rlike(r"^[0-9]+(\.[A-Za-z]{1,5})?$"), F.concat(F.lit("{n}"), end(s)))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(s.rlike(r"^[0-9a-f-]{8,}(\.[A-Za-z]{1,5})?$"), F.concat(F.lit("{hex}"), end(s)))
        .when((F.length(s) >= 6) & s.rlike("[0-9]"), F.concat(F.lit("{id}"), end(s)))
        .otherwise(s)
    )
    return F.transform(parts, form)


def _apart(n1: Column, g1: Column, n2: Column, g2: Column, z: float) -> Column:
    """Whether the shares g1 / n1 and g2 / n2 differ by more than ``z`` standard errors of their common share."""
    n1, n2 = F.greatest(n1, F.lit(1)), F.greatest(n2, F.lit(1))
    p = (g1 + g2) / (n1 + n2)
    return F.abs(g1 / n1 - g2 / n2) > F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)) * z


def merged_branches(told: DataFrame, z: float) -> DataFrame:
    """host, template, child, branch: the name of what each of the ``told`` children of a node (host, template, child, labelled, good) is merged into.

    By their share of good labels, each is tested against the next one, and those that can't be told apart merge,
    under the least of them; one alone keeps its name.
    """
    by = Window.partitionBy("host", "template").orderBy(F.col("good") / F.col("labelled"), "child")
    differs = _apart(F.col("labelled"), F.col("good"), F.lag("labelled").over(by), F.lag("good").over(by), z)
    cut = told.select("*", F.coalesce(differs, F.lit(True)).cast("int").alias("cut")).select("*", F.sum("cut").over(by).alias("group"))
    group = Window.partitionBy("host", "template", "group")
    return cut.select("host", "template", "child", F.when(F.count("*").over(group) > 1, F.concat(F.lit("~"), F.min("child").over(group))).otherwise(F.col("child")).alias("branch"))


def path_templates(paths: DataFrame, *, min_support: int = 5, max_children: int = 16, z: float = 1.96) -> DataFrame:
    """host, segs, template of the distinct ``paths`` (host, segs, n, labelled, good).

    Goes down the trees of all hosts to the last segment.  At a node, a child that varies by form
    stays.  Those whose share of good labels can be told from that of their siblings, however
    many they are, stand apart, where ``merged_branches`` joins those that are alike.  Of the others, one of under ``min_support`` pages beside many becomes
    ``*``, and the rest, which no label tells from the whole, merge into ``+``.  Each round sums by node and child, so a hot host arrives
    as its distinct children; what all paths of a node share is gone down in one round, so there are as
    many rounds as a path has branchings.
    """
    rows = paths.withColumn("template", F.array().cast("array<string>"))
    ended = F.size("template") == F.size("segs")
    done = [rows.where(ended)]
    while (still := rows.where(~ended)).head(1):
        inner = still.withColumn("rest", F.slice("segs", F.size("template") + 1, F.size("segs") - F.size("template"))).withColumn("child", F.col("rest")[0])
        kids = durable(inner.groupBy("host", "template", "child").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "good")], F.min("rest").alias("low"), F.max("rest").alias("high")), "url-children")
        node = kids.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("labelled").alias("all_l"), F.sum("good").alias("all_g"))
        rest_l, rest_g = F.col("all_l") - F.col("labelled"), F.col("all_g") - F.col("good")
        kids = kids.join(node, ["host", "template"])
        told = kids.where((F.col("labelled") > 0) & (rest_l > 0) & _apart(F.col("labelled"), F.col("good"), rest_l, rest_g, z) & ~F.col("child").startswith("{"))
        kids = kids.join(merged_branches(told.select("host", "template", "child", "labelled", "good"), z), ["host", "template", "child"], "left")
        rare = (F.col("kids") > max_children) & (F.col("n") < min_support)
        name = F.coalesce(F.when(F.col("child").startswith("{"), F.col("child")), F.col("branch"), F.when(rare, "*").otherwise("+"))
        # the least and the greatest of an only child's paths share what all of them share
        differs = F.array_position(F.zip_with("low", "high", lambda x, y: ~x.eqNullSafe(y)), True).cast("int")
        shared = F.slice("low", F.lit(1), F.when(differs > 0, differs - 1).otherwise(F.size("low")))
        steps = F.when(F.col("kids") == 1, F.transform(shared, lambda s: F.when(s.startswith("{") | (F.col("n") >= min_support), s).otherwise("+"))).otherwise(F.array(name))
        names = kids.select("host", "template", "child", steps.alias("steps"))
        rows = durable(inner.join(names, ["host", "template", "child"]).withColumn("template", F.concat("template", "steps")).select(rows.columns), "url-templates")
        done.append(rows.where(ended))
    return reduce(DataFrame.unionByName, done).select("host", "segs", F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"), "labelled", "good")


def filter_urls(pages: DataFrame, labels: DataFrame, *, rules: tuple[tuple[str, str, str], ...] = RULES, min_purity: float = 0.5, weight: float = 10.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of each row.

    Where no rule fits, the verdict is that of the row's template: its share of good labels
    (quality 1 and not toxic), smoothed by ``weight`` labels of its host's share, which is
    smoothed by those of all.  ``labels`` has doc_id, quality, toxic for page ids.

    Nulls: a null url, or one without ``://``, has empty host and path and is judged with its
    like; null ids have no label, null marks count as not bad; several labels of an id are one,
    bad if any is.  Repeated rows get equal verdicts.  Without labels all that no rule blocks is
    allowed.  An empty table gives no rows.  Other columns aren't read.
    """
    host, path = host_and_path(F.col(url_col))
    given = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select("*", segments(F.col("path")).alias("segs"))
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((~F.bool_or(bad)).cast("long").alias("good"))
    marked = given.select("page_id", "host", "segs").join(marks, F.col("page_id") == F.col("doc_id"), "left")
    paths = durable(marked.groupBy("host", "segs").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good")), "url-paths")
    rows = path_templates(paths)
    total = paths.agg(F.sum("good"), F.sum("labelled")).first()
    prior = (total[0] + 1) / (total[1] + 1) if total[1] else 1.0
    by_host = rows.groupBy("host").agg(((F.sum("good") + weight * prior) / (F.sum("labelled") + weight)).alias("host_purity"))
    by_template = rows.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")).join(by_host, "host")
    judged = rows.select("host", "segs", "template").join(by_template.select("host", "template", ((F.col("good") + weight * F.col("host_purity")) / (F.col("labelled") + weight)).alias("purity")), ["host", "template"])
    out = given.join(judged, ["host", "segs"]).select("*", longest_rule(rules, F.col("host"), F.col("path")).alias("r"))
    return out.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("purity") < min_purity, "block").otherwise("allow")).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op7_urls(spark, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))
