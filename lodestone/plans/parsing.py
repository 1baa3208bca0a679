"""Queries of parsing, roots, logs and other sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import budget, history, lifecycle, overlay, search
from ..sources import parse
from ..sources.views import Views, sql_with
from ..streaming import watch
from .catalog import PAIRS
from .registry import query

#: A source file of each language, where N is a number, and what it declares: kind, name, visibility, signature, doc.
SAMPLES = [
    ("src/mN.rs", "/// Runs N.\npub fn run_N(x: u8) -> u8 {\n    helper(x)\n}\npub(crate) struct SN {\n}\nfn helper(x: u8) -> u8 { x }\nuse crate::mN;\n", [("function", "run_N", "public", "fn run_N(x: u8) -> u8", "Runs N."), ("class", "SN", "crate", "struct SN", None), ("function", "helper", "private", "fn helper(x: u8) -> u8", None)], ["crate::mN"], [("helper", 1)]),
    ("pkg/mN.py", "import os.path\nfrom pkg.mN import x\n# Makes N.\nclass CN(Base):\n    def _go(self):\n        return run(N) + run(1)\n", [("class", "CN", "public", "class CN(Base)", "Makes N."), ("function", "_go", "private", "def _go(self)", None)], ["os.path", "pkg.mN"], [("run", 2)]),
    ("web/mN.ts", "import { a } from './mN';\n/** Adds N. */\nexport function addN(a: number): number {\n  return go(a);\n}\nclass Hidden {}\n", [("function", "addN", "public", "function addN(a: number): number", "Adds N."), ("class", "Hidden", "private", "class Hidden", None)], ["./mN"], [("go", 1)]),
    ("srv/mN.go", 'import "example.com/o/r/srv"\n// Serve N.\nfunc (s *T) ServeN(w int) error {\n\treturn s.do(w)\n}\ntype small struct {\n}\n', [("function", "ServeN", "public", "func ServeN(w int) error", "Serve N."), ("type", "small", "private", "type small struct", None)], ["example.com/o/r/srv"], [("do", 1)]),
    ("src/main/java/p/MN.java", "import p.MN;\n/** Holds N. */\npublic final class MN {\n  private static int sizeN(int a) {\n    return a;\n  }\n}\n", [("class", "MN", "public", "class MN", "Holds N."), ("function", "sizeN", "private", "int sizeN(int a)", None)], ["p.MN"], []),
    ("lib/mN.dart", "import 'package:app/mN.dart';\n/// Shows N.\nclass _WN {\n}\nvoid mainN() {\n}\n", [("class", "_WN", "private", "class _WN", "Shows N."), ("function", "mainN", "public", "void mainN()", None)], ["package:app/mN.dart"], []),
]


def _files(v: Views) -> DataFrame:
    """One file of SAMPLES for each page."""
    at = F.col("page_id") % len(SAMPLES)
    pick = lambda i: F.replace(F.element_at(F.array(*[F.lit(s[i]) for s in SAMPLES]), (at + 1).cast("int")), F.lit("N"), F.col("page_id").cast("string"))
    return v.table("pages").select("page_id", pick(0).alias("path"), pick(1).alias("content"))


def _said(rows: list[tuple]) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "replace('" + x.replace("'", "''") + "', 'N', page_id::VARCHAR)"
    return " UNION ALL ".join(f"SELECT {', '.join(map(cell, r[1:]))} FROM pages WHERE page_id % {len(SAMPLES)} = {r[0]}" for r in rows)


@query("WITH d(path, position, kind, name, visibility, signature, doc) AS (" + _said([(i, s[0], k, *d) for i, s in enumerate(SAMPLES) for k, d in enumerate(s[2])]) + ") SELECT * FROM d")
def declarations(v: Views) -> DataFrame:
    return parse.declarations(_files(v)).select("path", "position", "kind", "name", "visibility", "signature", "doc")


@query("WITH d(path, target) AS (" + _said([(i, s[0], t) for i, s in enumerate(SAMPLES) for t in s[3]]) + ") SELECT * FROM d")
def import_refs(v: Views) -> DataFrame:
    return parse.import_refs(_files(v)).select("path", "target")


@query("WITH d(path, name, n) AS (" + _said([(i, s[0], *c) for i, s in enumerate(SAMPLES) for c in s[4]]) + ") SELECT path, name, n::BIGINT AS n FROM d")
def call_refs(v: Views) -> DataFrame:
    return parse.call_refs(_files(v))


@query("WITH d(path, target, resolved) AS (" + _said([(i, s[0], s[3][-1], s[0]) for i, s in enumerate(SAMPLES) if i != 3]) + """) SELECT * FROM d UNION ALL SELECT 'srv/m' || a.page_id || '.go', 'example.com/o/r/srv', 'srv/m' || b.page_id || '.go' FROM pages a JOIN pages b ON a.page_id % 6 = 3 AND
b.page_id % 6 = 3""")
def imported_files(v: Views) -> DataFrame:
    f = _files(v)
    return parse.imported_files(parse.import_refs(f), f)


@query(sql_with("commits changes", "SELECT 'r' || revision AS revision, 'a' || author AS author, date_trunc('second', ts) AS ts, path FROM commits LEFT JOIN changes USING (revision) WHERE revision % 3 = 0"))
def git_log(v: Views) -> DataFrame:
    lists = v.changes.groupBy("revision").agg(F.array_join(F.collect_list("path"), "\n").alias("paths"))
    c = v.commits.where("revision % 3 = 0").join(lists, "revision", "left")
    record = F.concat_ws("\n", F.concat(F.lit("r"), "revision"), F.concat(F.lit("a"), "author"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), "paths")
    return parse.log_records(c.select(record.alias("record"))).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT 'root_' || n_regionkey AS root_id, CASE WHEN min(n_nationkey % 4) = 0 THEN 'primary' WHEN min(n_nationkey % 4) = 1 THEN 'worktree' WHEN min(n_nationkey % 4) = 2
THEN 'submodule' ELSE 'branch' END AS kind, arg_min(n_name, (n_nationkey % 4, n_name)) AS location FROM nation GROUP BY n_regionkey""")
def discovered_roots(v: Views) -> DataFrame:
    k = F.col("n_nationkey") % 4
    return parse.roots(v.table("nation").select(F.concat(F.lit("root_"), "n_regionkey").alias("root_id"), F.when(k == 0, "primary").when(k == 1, "worktree").when(k == 2, "submodule").otherwise("branch").alias("kind"), F.col("n_name").alias("location")))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'renamed' WHEN 1 THEN 'modified' WHEN 2 THEN 'removed' END AS change, CASE p_partkey % 4 WHEN 0 THEN p_partkey + 100000 END AS new FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT p_partkey + 200000, 'added', NULL FROM part WHERE p_partkey % 4 = 3""")
def changed_with_renames(v: Views) -> DataFrame:
    k, p = F.col("p_partkey"), v.table("part")
    body = F.concat(F.lit("body "), k)
    name = lambda moved: (k * 3 + moved).alias("id")  # noqa: E731  kept, renamed and added files have numbers apart, however many parts there are
    before = p.select(name(0), body.alias("content"))
    after = p.where(k % 4 != 2).select(F.when(k % 4 == 0, name(1)).otherwise(name(0)).alias("id"), F.when(k % 4 == 1, F.concat(body, F.lit("!"))).otherwise(body).alias("content"))
    more = p.where(k % 4 == 3).select(name(2), F.concat(F.lit("new "), k).alias("content"))
    told = lambda c: (F.floor(F.col(c) / 3) + F.pmod(F.col(c), F.lit(3)) * 100000).alias(c)
    return lifecycle.changed_with_renames(before, after.unionByName(more), "id", "content").select(told("id"), "change", told("new"))


@query(sql_with("commits changes", PAIRS + """, t AS (SELECT revision, author, ts FROM changes JOIN commits USING (revision) WHERE path = 'part_7'), n AS (SELECT author, count(*) AS n FROM t GROUP BY author),
p AS (SELECT CASE WHEN left_path = 'part_7' THEN right_path ELSE left_path END AS other, n FROM pairs WHERE 'part_7' IN (left_path, right_path) ORDER BY n DESC, other LIMIT 5)
SELECT 'part_7' AS path, (SELECT count(*) FROM t) AS touches, (SELECT arg_max(revision, (ts, revision)) FROM t) AS last_revision, (SELECT arg_max(author, (n, -author))
FROM n) AS owner, (SELECT string_agg(other, ',' ORDER BY n DESC, other) FROM p) AS partners"""))
def path_card(v: Views) -> DataFrame:
    return history.path_card(v.commits, v.changes, "part_7").withColumn("partners", F.array_join("partners", ","))


@query("""SELECT l_orderkey AS link, round(avg(l_discount * 10), 6) AS score, CASE WHEN avg(l_discount * 10) >= 0.85 THEN CASE WHEN min(l_discount * 10) < 0.9 THEN 'review_queue' ELSE 'high' END WHEN avg(l_discount * 10) >= 0.6 THEN 'review_queue' ELSE 'below_threshold' END AS tier FROM lineitem WHERE l_discount * 100 % 3 <> 1 GROUP BY 1""")
def demoted_tiers(v: Views) -> DataFrame:
    """Shares are added in the order of the table: a mean on the edge of a tier depends on it, and would else change from run to run."""
    row = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), (F.col("l_discount") * 10).alias("share"))
    g = v.table("lineitem").where("l_discount * 100 % 3 != 1").select(F.col("l_orderkey").alias("link"), row.alias("s")).groupBy("link").agg(F.array_sort(F.collect_list("s")).alias("s"))
    g = g.select("link", (F.aggregate("s", F.lit(0.0), lambda a, x: a + x["share"]) / F.size("s")).alias("score"), F.array_min(F.transform("s", lambda x: x["share"])).alias("weakest"))
    return g.select("link", F.round("score", 6).alias("score"), budget.demoted_tier(F.col("score"), F.col("weakest")).alias("tier"))


@query(sql_with("commits changes", """, t AS (SELECT path AS item, count(*) AS n FROM changes JOIN commits USING (revision) GROUP BY path), s AS (SELECT item, CASE WHEN n >= 20 THEN 3 WHEN n >= 10 THEN 2 ELSE
1 END AS priority FROM t WHERE n >= 5),
a AS (SELECT 'link_' || p_partkey AS item, CASE p_size % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS priority FROM part) SELECT item, priority, source FROM (SELECT item,
priority, 'structural' AS source, 0 AS r FROM s UNION ALL SELECT item, priority, 'overlay', 1 FROM a) ORDER BY priority DESC, r, item LIMIT 30"""))
def all_handoffs(v: Views) -> DataFrame:
    hot = overlay.handoffs(v.changes.join(v.commits, "revision").groupBy("path").agg(F.count("*").alias("touches")), 1 << 30).select(F.col("path").alias("item"), "priority")
    size = F.col("p_size") % 3
    said = v.table("part").select(F.concat(F.lit("link_"), "p_partkey").alias("item"), F.when(size == 0, 3).when(size == 1, 2).otherwise(1).alias("priority"))
    return overlay.all_handoffs(hot, said, 30)


@query(sql_with("lines", """SELECT path, line_number::INT AS line_number FROM (SELECT path || CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.txt' END AS path, line_number, line FROM
lines) WHERE contains(line, 'the') AND NOT ends_with(path, '.txt') AND NOT ends_with(path, '.py')"""))
def typed_search(v: Views) -> DataFrame:
    k = F.col("doc_id") % 3
    lines = v.lines.withColumn("path", F.concat("path", F.when(k == 0, ".rs").when(k == 1, ".py").otherwise(".txt")))
    return search.lexical(lines, "the", literal=True, types=("rust", "python"), not_types=("python",)).select("path", F.col("line_number").cast("int").alias("line_number"))


@query(sql_with("lines", """, g AS (SELECT root_id, path, count(*) * 20 + sum(least(length(line), 160)) // 3 AS cost FROM lines WHERE contains(line, 'the') GROUP BY ALL), r AS (SELECT *, sum(cost)
OVER w AS spent, row_number() OVER w AS rn FROM g WINDOW w AS (PARTITION BY root_id ORDER BY path))
SELECT root_id, path, spent::BIGINT AS spent FROM r WHERE spent <= 4000 OR rn = 1"""))
def group_budget_cut(v: Views) -> DataFrame:
    g = v.lines.where(F.col("line").contains("the")).groupBy("root_id", "path").agg((F.count("*") * 20 + F.floor(F.sum(F.least(F.length("line"), F.lit(160))) / 3)).cast("long").alias("cost"))
    return budget.prefix_cut(g, "root_id", ["path"], "cost", 4000).select("root_id", "path", "spent")


@query("SELECT event_id, CASE event_id % 5 WHEN 4 THEN 'src/b.rs' ELSE 'src/a.rs' END AS base FROM events")
def temp_siblings(v: Views) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("src/a.rs.tmp", "src/a.rs~", "src/.a.rs.swp", "src/.#a.rs", "src/b.rs"))), (F.col("event_id") % 5 + 1).cast("int"))
    return v.events.select("event_id", watch.temp_base(path).alias("base"))


@query("SELECT event_id, ['queries', 'boxes', 'branches', 'days', 'maps', 'class', 'is'][event_id % 7 + 1] AS plural FROM events")
def plural_words(v: Views) -> DataFrame:
    w = F.element_at(F.array(*map(F.lit, ("query", "box", "branch", "day", "map", "class", "is"))), (F.col("event_id") % 7 + 1).cast("int"))
    return v.events.select("event_id", text.plural(w).alias("plural"))


@query(sql_with("files symbols", """, c AS (SELECT language, CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END END AS n,
split_part(id, '_', 2)::BIGINT % 25 + 1 AS b FROM files), m AS (SELECT file, count(*) AS missing FROM symbols WHERE doc_comment IS NULL AND visibility IN ('public',
'crate') GROUP BY file)
SELECT language, count(*) AS n_files, max(n)::INT AS max_lines, coalesce(max(missing), 0) AS max_missing FROM c LEFT JOIN m ON file = 'Brand#' || b GROUP BY language"""))
def suggestion_groups(v: Views) -> DataFrame:
    missing = v.symbols.where("doc_comment IS NULL AND visibility IN ('public', 'crate')").groupBy("file").agg(F.count("*").alias("missing"))
    f = v.files.select("language", text.line_count(F.col("content")).alias("n"), F.concat(F.lit("Brand#"), F.element_at(F.split("id", "_"), -1).cast("long") % 25 + 1).alias("file"))
    return f.join(missing, "file", "left").groupBy("language").agg(F.count("*").alias("n_files"), F.max("n").alias("max_lines"), F.coalesce(F.max("missing"), F.lit(0).cast("long")).alias("max_missing"))


@query(sql_with("commits changes", "SELECT path, count(*) AS touches FROM changes JOIN commits USING (revision) GROUP BY path"))
def cached_touches(v: Views) -> DataFrame:
    cache = watch.RevisionCache(lambda: v.changes.join(v.commits, "revision").groupBy("path").agg(F.count("*").alias("touches")))
    cache.at("old")
    return cache.at("new")
