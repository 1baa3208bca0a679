"""Cards: what is told about a file, a symbol, a module or a node, joined from the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import parse
from ..sources.scratch import held, hot_pairs, tasks_of
from .graph import degree_map, edges_report
from .similarity import edge_drift

#: Partners of files that one task gathers.
PARTNERS_A_TASK = 1_000_000

#: Kinds of symbols that resolution knows.
SYMBOL_KINDS = ("function", "method", "class", "trait", "interface", "module", "constant", "type")
#: Kinds of edges, and where each comes from.
EDGE_KINDS = {"defines": "parser_observed", "calls": "parser_observed", "imports": "parser_observed", "inherits": "parser_observed", "references": "parser_observed", "mentions": "human_declared", "governs": "human_declared", "co_changes_with": "git_observed"}


def live(rows: DataFrame) -> DataFrame:
    """Rows that aren't retired (retired_at is null)."""
    return rows.where("retired_at IS NULL")


def lookup(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The live nodes (id, retired_at) of the given ids, by id; unknown ids give nothing."""
    return live(nodes).where(F.col("id").isin(*ids)).orderBy("id")


def resolution_scan(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live symbols (id, kind, retired_at) of known kinds, and how many of unknown kinds were passed over."""
    known = F.col("kind").isin(*SYMBOL_KINDS)
    return live(symbols).where(known), live(symbols).where(~known).agg(F.count("*").alias("skipped"))


def edge_kind(name: str) -> str:
    """The kind that a snake or Camel name stands for."""
    snake = "".join("_" + c.lower() if c.isupper() else c for c in name).lstrip("_")
    if snake not in EDGE_KINDS:
        raise ValueError(f"no edge kind {name!r}")
    return snake


def provenance(kind: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k, EDGE_KINDS[k]).otherwise(rest), EDGE_KINDS, F.lit(None).cast("string"))


def provenance_audit(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """what, other, provenance: the node itself and its edges in both directions."""
    own = nodes.where(F.col("id") == node).select(F.lit("node").alias("what"), F.lit(None).cast("string").alias("other"), F.lit("parser_observed").alias("provenance"))
    out = edges.where(F.col("src") == node).select(F.concat(F.lit("outbound:"), "kind").alias("what"), F.col("dst").alias("other"), provenance(F.col("kind")).alias("provenance"))
    back = edges.where(F.col("dst") == node).select(F.concat(F.lit("inbound:"), "kind").alias("what"), F.col("src").alias("other"), provenance(F.col("kind")).alias("provenance"))
    return own.unionByName(out).unionByName(back)


def graph_export(nodes: DataFrame, edges: DataFrame, drift: DataFrame) -> DataFrame:
    """id, type, label, in_degree, out_degree, degree, drift of each node; ``drift`` has id and score."""
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return nodes.join(degree_map(edges), "id", "left").join(drift.select("id", "score"), "id", "left").select("id", "type", "label", none("in_degree"), none("out_degree"), none("degree"), F.coalesce("score", F.lit(0.0)).alias("drift"))


def impact_files(edges: DataFrame, owners: DataFrame, node: str, direction: str = "both") -> DataFrame:
    """direction, file: the distinct files (owners: id, file) whose nodes calls or imports link to ``node``; both directions may name one file."""
    e = edges.where(F.col("kind").isin("calls", "imports"))
    ways = {"inbound": e.where(F.col("dst") == node).select(F.col("src").alias("id")), "outbound": e.where(F.col("src") == node).select(F.col("dst").alias("id"))}
    asked = ways if direction == "both" else {direction: ways[direction]}
    return reduce(DataFrame.unionByName, [w.join(owners, "id").select(F.lit(d).alias("direction"), "file").distinct() for d, w in asked.items()])


def call_entries(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """id, path of the symbols (id, file_id, qualified_name, kind) whose file (file_id, path) makes them entry points of call paths."""
    return symbols.join(files, "file_id").where(text.call_path_entry(F.col("qualified_name"), F.col("path"), F.col("kind"))).select("id", "path")


def governed_files(concepts: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst: from each concept (concept, paths) to the files (id, path) that it declares to govern; unknown paths are left out."""
    return concepts.select("concept", F.explode("paths").alias("path")).distinct().join(files, "path").select(F.col("concept").alias("src"), F.col("id").alias("dst"))


def governing_concepts(governs: DataFrame, concepts: DataFrame, node: str) -> DataFrame:
    """The concepts (id, title) that govern a node."""
    return governs.where(F.col("dst") == node).select(F.col("src").alias("id")).distinct().join(concepts, "id")


def _test_sides(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of files (path): source, stem, folder of each; test, inside, stem of those that test a stem by name; test, folder of those that test a folder by place.

    A name gives the stem that it may test and a folder ``tests`` or ``__tests__`` the folder, so both
    meet by equality.  A stem prefix is met at each of its ends, as ``a_test_b`` tests ``a`` and, by the looser rule of
    prefixes, all that begins so.
    """
    files = files.select("path").distinct()
    name, folder = text.file_name(F.col("path")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    stem = F.when(name.rlike(r"^.+\."), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    source = files.select(F.col("path").alias("source"), stem.alias("stem"), folder.alias("folder"))
    before = F.filter(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.when(F.substring(name, i, F.lit(5)).isin("_test", ".test", ".spec"), F.substring(name, F.lit(1), i - 1))), lambda x: x != "")
    after = F.when(name.startswith("test_"), F.transform(F.sequence(F.lit(6), F.greatest(F.length(name), F.lit(6))), lambda i: F.substring(name, F.lit(6), i - 5))).otherwise(F.array().cast("array<string>"))
    plain = F.when(F.col("path").rlike(r"^tests/[^/]+\.(rs|py)$"), F.array(stem)).otherwise(F.array().cast("array<string>"))
    parts = F.split("path", "/")
    inside = F.filter(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.when(F.get(parts, i - 1).isin("tests", "__tests__") & (i < F.size(parts)), F.array_join(F.slice(parts, F.lit(1), i - 1), "/"))), lambda x: x.isNotNull())
    by_name = files.select(F.col("path").alias("test"), inside.alias("inside"), F.explode(F.array_distinct(F.concat(before, after, plain))).alias("stem"))
    by_place = files.select(F.col("path").alias("test"), F.explode(F.array_distinct(inside)).alias("folder"))
    return source, by_name, by_place


def _tested(source: DataFrame, by_name: DataFrame, by_place: DataFrame) -> DataFrame:
    """source, test and what else the two sides of tests have.  A source has one stem and one folder, so it meets a test once by each: no pairs are dealt out to tell doubles."""
    columns = ["source", "test", *[c for c in by_place.columns if c not in ("test", "folder")]]
    named = by_name.join(source, "stem").where((F.col("folder") == "") | ~F.array_contains("inside", F.col("folder"))).select(*columns)
    return named.unionByName(hot_pairs(source.where("folder != ''").select("folder", "source"), by_place, "folder").select(*columns))


def test_pairs(files: DataFrame) -> DataFrame:
    """source, test: the files (path) that by name or place test another one."""
    return _tested(*_test_sides(files))


def test_surface(pairs: DataFrame, symbols: DataFrame, calls: DataFrame, ordered: bool = True) -> DataFrame:
    """source, test, symbol, risk of the test symbols (id, path, name) of each source's tests (source, test).

    0.3 by path alone, 0.55 if the name is a test's too, 0.9 if it calls (src, dst) a symbol of the source; if ``ordered``, by risk descending, name.
    """
    tests = pairs.join(symbols.select(F.col("id").alias("symbol"), F.col("path").alias("test"), "name"), "test")
    called = calls.join(symbols.select(F.col("id").alias("dst"), F.col("path").alias("source")), "dst").select(F.col("src").alias("symbol"), "source", F.lit(True).alias("direct")).distinct()
    out = _at_risk(tests.join(called, ["symbol", "source"], "left"), F.col("direct"))
    return out.orderBy(F.desc("risk"), "name", "source", "symbol") if ordered else out


def test_surface_of(files: DataFrame, symbols: DataFrame, calls: DataFrame) -> DataFrame:
    """``test_surface`` of all pairs of the files (path), in no order.  Symbols and the files that each calls are told of a test before it meets its sources, so no pair is dealt out."""
    source, by_name, by_place = _test_sides(files)
    called = calls.join(symbols.select(F.col("id").alias("dst"), F.col("path").alias("source")), "dst").groupBy(F.col("src").alias("symbol")).agg(F.collect_set("source").alias("called"))
    known = held(symbols.select(F.col("id").alias("symbol"), F.col("path").alias("test"), "name").join(called, "symbol", "left"), "test-symbols")
    return _at_risk(_tested(source, by_name.join(known, "test"), by_place.join(known, "test")), F.array_contains("called", F.col("source")))


def _at_risk(tests: DataFrame, direct: Column) -> DataFrame:
    named = F.col("name").startswith("Test") | F.col("name").contains("test_") | F.col("name").contains("_test")
    return tests.select("source", "test", "symbol", F.when(direct, 0.9).when(named, 0.55).otherwise(0.3).alias("risk"), "name")


def file_cards(files: DataFrame, symbols: DataFrame, imports: DataFrame, pairs: DataFrame, most: int = 10) -> DataFrame:
    """file, n_symbols, symbols (the first ``most`` names), imported_by, imports, co_changes (partners not imported) of each file (file).

    ``symbols`` has file and name, ``imports`` src and dst, ``pairs`` left_path and right_path.
    """
    joined = lambda df, key, value, name: df.groupBy(F.col(key).alias("file")).agg(F.array_sort(F.collect_set(value)).alias(name))
    named = symbols.groupBy("file").agg(F.count("*").alias("n_symbols"), F.slice(F.array_sort(F.collect_list("name")), 1, most).alias("symbols"))
    pairs = held(pairs.select("left_path", "right_path"), "pairs")
    n = tasks_of(files.sparkSession, 2 * pairs.count(), PARTNERS_A_TASK)
    partners = pairs.select(F.col("left_path").alias("file"), F.col("right_path").alias("other")).unionByName(pairs.select(F.col("right_path").alias("file"), F.col("left_path").alias("other"))).repartition(n, "file")
    out = files.repartition(n, "file").join(named, "file", "left").join(joined(imports, "dst", "src", "imported_by"), "file", "left").join(joined(imports, "src", "dst", "imports"), "file", "left").join(joined(partners, "file", "other", "partners"), "file", "left")
    none = F.array().cast("array<string>")
    return out.select("file", F.coalesce("n_symbols", F.lit(0).cast("long")).alias("n_symbols"), *[F.coalesce(c, none).alias(c) for c in ("symbols", "imported_by", "imports")], F.array_except(F.coalesce("partners", none), F.coalesce("imports", none)).alias("co_changes"))


def cochange_minus_imports(pairs: DataFrame, imports: DataFrame) -> DataFrame:
    """file, other and more: partners of a file in pairs (left_path, right_path and more) that it doesn't import (src, dst) anyway, ties that only history shows.

    Imports meet the pairs as these lie, both ways, so the partners of all files aren't dealt out for it.
    """
    known = imports.select("src", "dst").distinct()
    one = lambda left, right, name: known.select(F.col(left).alias("left_path"), F.col(right).alias("right_path"), F.lit(True).alias(name))
    met = pairs.join(one("src", "dst", "imports"), ["left_path", "right_path"], "left").join(one("dst", "src", "imported"), ["left_path", "right_path"], "left")
    way = lambda found, file, other: F.when(F.col(found).isNull(), F.struct(F.col(file).alias("file"), F.col(other).alias("other")))
    ways = F.array_compact(F.array(way("imports", "left_path", "right_path"), way("imported", "right_path", "left_path")))
    more = [c for c in pairs.columns if c not in ("left_path", "right_path")]
    return met.select(F.explode(ways).alias("p"), *more).select("p.file", "p.other", *more)


def symbol_cards(symbols: DataFrame, calls: DataFrame, budget: str = "normal", most: int = 40, container: int = 2400) -> DataFrame:
    """id, defined_at, doc, outline, callers, callees of symbols (id, file, doc_comment, body_bytes, members).

    ``tiny`` has neither doc nor callers; ``deep`` alone has callers and callees (calls: src, dst).  A container of more than ``container`` bytes is outlined
    by its first ``most`` members.
    """
    none = F.array().cast("array<string>")
    doc = F.lit(None).cast("string") if budget == "tiny" else F.col("doc_comment")
    outline = F.when(F.col("body_bytes") > container, F.slice(F.array_sort("members"), 1, most)).otherwise(none)
    cards = symbols.select("id", F.col("file").alias("defined_at"), doc.alias("doc"), outline.alias("outline"))
    if budget != "deep":
        return cards.select("*", none.alias("callers"), none.alias("callees"))
    gather = lambda key, value, name: calls.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_set(value)).alias(name))
    return cards.join(gather("dst", "src", "callers"), "id", "left").join(gather("src", "dst", "callees"), "id", "left").select("id", "defined_at", "doc", "outline", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def module_cards(files: DataFrame, symbols: DataFrame, prefix: str) -> DataFrame:
    """what, name, n_symbols, n_public: the files (path) directly under a folder, the folders under it, and the total.

    ``symbols`` has path and visibility; the total isn't cut by visibility.
    """
    base = prefix.strip("/") + "/" if prefix.strip("/") else ""
    rest = F.substring("path", len(base) + 1, 1 << 30)
    inside = files.where(F.col("path").startswith(base)).select("path", F.split(rest, "/").alias("parts"))
    child = inside.select("path", F.when(F.size("parts") == 1, "file").otherwise("folder").alias("what"), F.col("parts")[0].alias("name"))
    counted = symbols.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "public").alias("p"))
    j = child.join(counted, "path", "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    each = j.groupBy("what", "name").agg(zero("n").alias("n_symbols"), zero("p").alias("n_public"))
    return each.unionByName(j.agg(zero("n").alias("n_symbols"), zero("p").alias("n_public")).select(F.lit("total").alias("what"), F.lit(base).alias("name"), "n_symbols", "n_public"))


def public_api(symbols: DataFrame, changed: DataFrame, prefix: str, days: int = 30) -> DataFrame:
    """id, entry_point, recent of the public and crate symbols (id, path, qualified_name, kind, visibility) of the files directly under a folder.

    recent: the newest change (path, ts) of its file is at most ``days`` before the newest of all.
    """
    base = prefix.strip("/") + "/"
    direct = symbols.where(F.col("path").startswith(base) & ~F.substring("path", len(base) + 1, 1 << 30).contains("/") & F.col("visibility").isin("public", "crate"))
    last = changed.groupBy("path").agg(F.max("ts").alias("ts"))
    now = changed.agg(F.max("ts").alias("now"))
    entry = text.entry_point_kind(F.col("qualified_name"), F.col("path"), F.col("kind"))
    return direct.join(last, "path", "left").crossJoin(F.broadcast(now)).select("id", entry.alias("entry_point"), F.coalesce(F.col("ts") >= F.col("now") - F.make_dt_interval(F.lit(days)), F.lit(False)).alias("recent"))


def entry_points(symbols: DataFrame, limit: int = 20) -> DataFrame:
    """id, kind, location of the entry points among symbols (id, qualified_name, path, kind), by kind's rank and location, up to ``limit``."""
    kind = text.entry_point_kind(F.col("qualified_name"), F.col("path"), F.col("kind"))
    rank = F.array_position(F.array(*map(F.lit, ("binary", "cli_command", "http_handler", "lib_root"))), F.col("entry"))
    found = symbols.select("id", kind.alias("entry"), F.col("path").alias("location")).where("entry IS NOT NULL")
    return found.orderBy(rank, "location", "id").limit(limit).select("id", F.col("entry").alias("kind"), "location")


def large_file_tags(path: Column, language: Column, lines: Column, source: Column, n_symbols: Column) -> Column:
    """What to say of a large file: its size and symbols, and where its language shows a root, modules or exports."""
    name, script = text.file_name(path), language.isin("typescript", "tsx", "javascript")
    some = F.array(
        F.lit("large_file"),
        F.when(lines >= 400, "over_repo_cap"),
        F.when(n_symbols >= 10, "many_symbols"),
        F.when((language == "rust") & name.isin("mod.rs", "lib.rs", "main.rs"), "rust_module_root"),
        F.when((language == "rust") & source.rlike(r"(?m)^\s*(pub )?mod "), "declares_modules"),
        F.when(script & source.contains("export "), "exports_api"),
        F.when(script & name.rlike(r"^index\.[^.]*$"), "module_barrel_or_root"),
    )
    tags = F.array_compact(some)
    return F.when(F.size(tags) == 1, F.array_append(tags, F.lit("extract_cohesive_units"))).otherwise(tags)


def documented_api(files: DataFrame) -> DataFrame:
    """path, name of what must be documented of the symbols that files (path, content) declare.

    In JavaScript what is exported by ``export``, ``exports.x`` or ``module.exports``; in Python what ``__all__`` names,
    what the ``__init__`` of its folder re-exports, and all public names of an ``__init__``; else what is public.
    """
    declared = parse.declarations(files).select("path", "language", "name", "visibility")
    words = lambda pattern: F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
    listed = lambda lists: F.filter(F.flatten(F.transform(lists, lambda x: F.split(x, r"[^\w$]+"))), lambda x: x != "")
    f = files.select("path", "content", text.language_of(F.col("path")).alias("language"))
    script = F.concat(words(r"(?m)^[ \t]*export +(?:default +)?(?:async +)?(?:function|class|const|let|var)\*? +([\w$]+)"), words(r"(?<![\w.])(?:module\.)?exports\.([\w$]+) *="), listed(words(r"(?:export +|module\.exports *= *)\{([^}]*)\}")))
    python = listed(words(r"__all__ *\+?= *[\[(]([^\])]*)[\])]"))
    named = f.select("path", F.explode(F.when(F.col("language") == "javascript", script).when(F.col("language") == "python", python).otherwise(F.array().cast("array<string>"))).alias("name"))
    init = f.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", "__init__\\.py$", "").alias("folder"), F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^from +\.(\w+ +import +[\w, ]+)"), F.lit(1))).alias("line"))
    again = init.select(F.concat("folder", F.regexp_extract("line", r"^(\w+)", 1), F.lit(".py")).alias("path"), F.explode(F.split(F.regexp_replace("line", r"^\w+ +import +", ""), " *, *")).alias("name")).select("path", F.trim("name").alias("name"))
    own = declared.where((~F.col("language").isin("javascript", "python") | F.col("path").rlike(r"(^|/)__init__\.py$")) & (F.col("visibility") == "public")).select("path", "name")
    return declared.select("path", "name").distinct().join(named.unionByName(again).unionByName(own).distinct(), ["path", "name"])


def hit_files(hits: DataFrame, files: DataFrame) -> DataFrame:
    """root_id, path, n, file_id of search hits (root_id, path) by file (id, root_id, path); file_id is null where the graph has no such file."""
    n = hits.groupBy("root_id", "path").agg(F.count("*").alias("n"))
    return n.join(files.select("root_id", "path", F.col("id").alias("file_id")), ["root_id", "path"], "left")


def edges_with_drift(edges: DataFrame, scores: DataFrame, query: str, limit: int = 100) -> DataFrame:
    """src, dst, kind, omitted, drift of the edges that a query names: ``outbound <node> [kind]`` or ``inbound <node> [kind]``."""
    direction, node, *kind = query.split()
    if direction not in ("outbound", "inbound") or len(kind) > 1:
        raise ValueError(f"no edge query: {query!r}")
    asked = edges.where(F.col("kind") == edge_kind(kind[0])) if kind else edges
    return edge_drift(edges_report(asked, node, direction, limit), scores, "omitted")


def minimum_context(edges: DataFrame, partners: DataFrame, node: str, budget: str = "normal", most: int = 20) -> DataFrame:
    """section, other, place: the focal node, up to ``most`` neighbours (calls, then imports), the governing concepts, co-change partners, and counts.

    ``partners`` has file, other, n; 3 are told, at ``deep`` 5.  ``tiny`` has the focal node and counts alone.
    """
    spark = edges.sparkSession
    ends = edges.where(F.col("kind").isin("calls", "imports")).where((F.col("src") == node) | (F.col("dst") == node))
    near = ends.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("other"), "kind").groupBy("other").agg(F.min("kind").alias("kind"))
    governs = edges.where((F.col("kind") == "governs") & (F.col("dst") == node)).select(F.col("src").alias("other")).distinct()
    own = partners.where(F.col("file") == node)
    counted = lambda name, df: df.agg(F.count("*").alias("place")).select(F.lit("count").alias("section"), F.lit(name).alias("other"), "place")
    out = spark.createDataFrame([("focal", node, 0)], "section string, other string, place long").unionByName(counted("neighbours", near)).unionByName(counted("governing", governs)).unionByName(counted("co_changes", own))
    if budget == "tiny":
        return out
    ranked = lambda name, df, order, n: df.orderBy(*order).limit(n).select(F.lit(name).alias("section"), "other", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
    out = out.unionByName(ranked("neighbour", near, ["kind", "other"], most)).unionByName(ranked("governing", governs, ["other"], most))
    return out.unionByName(ranked("co_change", own, [F.desc("n"), F.col("other")], 5 if budget == "deep" else 3))


def resolve_references(refs: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """ref, symbol: the one symbol (id, name, qualified_name, file, visibility, root_id) that each reference (ref, target, file, root_id) names.

    A target with ``::`` is met by whole name if any symbol has it, else by its last part, in the same root.  The score is that of calls:
    100 in the same file, 50 imported (file, target_file), 20 public, 10 crate, -100 private elsewhere.  The best stands if it is above 0 and alone.
    """
    s = symbols.select(F.col("id").alias("symbol"), "name", "qualified_name", F.col("file").alias("s_file"), "visibility", "root_id")
    whole = refs.where(F.col("target").contains("::")).join(s.select(F.col("qualified_name").alias("target")).distinct(), "target", "left_semi")
    rest = refs.join(whole.select("ref").distinct(), "ref", "left_anti")
    columns = ["ref", "called", "file", "root_id"]
    met = _best_named(whole.withColumn("called", F.col("target")).select(columns), s.withColumnRenamed("qualified_name", "called"), imported)
    met = met.unionByName(_best_named(rest.withColumn("called", F.element_at(F.split("target", "::"), -1)).select(columns), s.withColumnRenamed("name", "called"), imported))
    some = met.groupBy("ref", "score").agg(F.sum("n").alias("n"), F.min("symbol").alias("symbol"))
    best = some.groupBy("ref").agg(F.max(F.struct("score", "n", "symbol")).alias("b"))
    return best.where("b.score > 0 AND b.n = 1").select("ref", F.col("b.symbol").alias("symbol"))


def _best_named(refs: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """ref, score, n, symbol: how many symbols (symbol, called, root_id, s_file, visibility) may stand for a reference (ref, called, file, root_id), and the least.

    One in the same file is better than any imported, and one of these, unless private, than any elsewhere.  So symbols are counted first by name and root,
    with their file and without, and a reference meets a count of its own file, one of each file that its own imports, and one of all files:
    however many symbols have a name, they don't meet its references one by one.
    """
    seen = F.col("visibility")
    shown = symbols.withColumn("score", F.when(seen == "public", 20).when(seen == "crate", 10).otherwise(0))

    def counted(some: DataFrame, *keys: str) -> DataFrame:
        n = some.groupBy(*keys, "score").agg(F.count("*").alias("n"), F.min("symbol").alias("symbol"))
        return n.groupBy(*keys).agg(F.max(F.struct("score", "n", "symbol")).alias("b")).select(*keys, "b.score", "b.n", "b.symbol")

    told = lambda df, more: df.select("ref", (F.col("score") + more).alias("score"), "n", "symbol")
    same = told(refs.withColumn("s_file", F.col("file")).join(counted(shown, "called", "root_id", "s_file"), ["called", "root_id", "s_file"]), 100)
    known = imported.select("file", F.col("target_file").alias("s_file")).where("file != s_file").distinct()
    near = told(refs.join(known, "file").join(counted(shown.where("NOT visibility <=> 'private'"), "called", "root_id", "s_file"), ["called", "root_id", "s_file"]), 50)
    return same.unionByName(near).unionByName(told(refs.join(counted(shown.where("score > 0"), "called", "root_id"), ["called", "root_id"]), 0))


def snapshot(df: DataFrame, key: Column | None = None, most_bytes: int | None = None) -> DataFrame:
    """The rows as they are now, written to a table of the shared folder and read from there.

    With ``most_bytes``, the ceiling of a graph that is published in memory, it is an error if the keys alone exceed it.
    """
    if most_bytes is not None and (size := df.agg(F.sum(F.octet_length(key))).first()[0] or 0) > most_bytes:
        raise ValueError(f"the keys have {size} bytes, more than the {most_bytes} of a snapshot in memory")
    return held(df, "snapshot")
