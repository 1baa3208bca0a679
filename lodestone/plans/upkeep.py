"""Queries of upkeep, audit and sources, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prose, text
from ..operators import budget, lifecycle, overlay, similarity, upkeep
from ..sources import files as sources
from ..sources import parse, scratch
from ..sources.views import Views, sql_with
from ..streaming import watch
from .catalog import ALL, DRIFT, EDGES, LINKS, STOP, _link_events, _links, _scores
from .registry import query

STATE = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'pending_promotion' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'rejected' ELSE 'active' END"
EVENT = "CASE event_type WHEN 'view' THEN 'generated' WHEN 'click' THEN 'pending' WHEN 'purchase' THEN 'promoted' WHEN 'error' THEN 'rejected' ELSE 'rolled_back' END"


@query(f"SELECT user_id AS link, event_id AS seq, {EVENT} AS event, lag({STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS before, {STATE} AS after FROM events")
def audit_rows(v: Views) -> DataFrame:
    return upkeep.audited(_link_events(v))


@query(f"SELECT seq, event, before, after FROM (SELECT user_id AS link, event_id AS seq, {EVENT} AS event, lag({STATE}) OVER (PARTITION BY user_id ORDER BY event_id) AS before, {STATE} AS after FROM events) WHERE link = 3 ORDER BY seq")
def audit_of_link(v: Views) -> DataFrame:
    return upkeep.audited(_link_events(v)).where("link = 3").orderBy("seq").select("seq", "event", "before", "after")


@query("""WITH s AS (SELECT o_orderkey AS link, o_orderstatus AS state, o_totalprice AS score FROM orders WHERE o_orderkey % 3 <> 0), g AS (SELECT o_orderkey AS link, o_totalprice * 2 AS score FROM orders WHERE o_orderkey % 2 = 0)
SELECT link, CASE WHEN g.score IS NOT NULL THEN 'active' ELSE state END AS state, coalesce(g.score, s.score) AS score, CASE WHEN g.score IS NULL THEN NULL WHEN state IS
NULL THEN 'generated' ELSE 'regenerated' END AS event FROM s FULL JOIN g USING (link)""")
def candidate_upserts(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_orderkey").alias("link"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("score"))
    after, audit = upkeep.upsert_candidates(o.where("link % 3 != 0"), o.where("link % 2 = 0").select("link", (F.col("score") * 2).alias("score")))
    return after.join(audit, "link", "left")


@query("WITH x AS (SELECT 1)" + LINKS + """, d AS (SELECT link, any_value(path) AS path, max(hash) AS hash, max(score) AS score FROM links GROUP BY link), n AS (SELECT link, score + 0.3 AS new FROM d WHERE link % 4 = 0)
SELECT link, coalesce(now, hash) AS hash, round(coalesce(new, score), 6) AS score, CASE WHEN coalesce(new, score) >= 0.85 THEN 'high' WHEN coalesce(new, score) >= 0.6 THEN 'review_queue' ELSE 'below_threshold' END AS tier
FROM (SELECT link, min(path) AS path, max(hash) AS hash, max(score) AS score FROM links GROUP BY link) d LEFT JOIN n USING (link) LEFT JOIN now USING (path)""")
def refreshed_links(v: Views) -> DataFrame:
    links, now = _links(v)
    d = links.groupBy("link").agg(F.min("path").alias("path"), F.max("hash").alias("hash"), F.max("score").alias("score"))
    return upkeep.refreshed(d, d.where("link % 4 = 0").select("link", (F.col("score") + 0.3).alias("score")), now).withColumn("score", F.round("score", 6))


NOTE_EVENT = "CASE event_id % 11 WHEN 10 THEN 'forgotten' WHEN 9 THEN 'superseded' WHEN 8 THEN 'linked' ELSE CASE event_id % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'verified' ELSE 'stale' END END"


@query(f"""WITH e AS (SELECT event_id % 400 AS note, event_id AS seq, {NOTE_EVENT} AS event FROM events), g AS (SELECT note, bool_or(event = 'forgotten') AS f, bool_or(event =
'superseded') AS u, arg_max(event, seq) FILTER (event IN ('added', 'verified', 'stale')) AS l FROM e GROUP BY note)
SELECT note, CASE WHEN f THEN 'forgotten' WHEN u THEN 'superseded' WHEN l = 'stale' THEN 'stale' WHEN l = 'verified' THEN 'verified' ELSE 'active' END AS status FROM g""")
def note_states(v: Views) -> DataFrame:
    k = F.col("event_id")
    event = F.when(k % 11 == 10, "forgotten").when(k % 11 == 9, "superseded").when(k % 11 == 8, "linked").when(k % 3 == 0, "added").when(k % 3 == 1, "verified").otherwise("stale")
    return upkeep.note_states(v.events.select((k % 400).alias("note"), k.alias("seq"), event.alias("event")))


@query("WITH x AS (SELECT 1)" + LINKS + "SELECT freshness, count(*) AS n FROM fresh GROUP BY freshness")
def link_drift_scan(v: Views) -> DataFrame:
    links, now = _links(v)
    return upkeep.link_drift_scan(links.select("path", "hash", "valid"), now)


@query("""SELECT count(*) FILTER (p_size % 4 = 2) AS inserted, count(*) FILTER (p_size % 4 = 1) AS updated, count(*) FILTER (p_size % 4 = 0) AS retired, count(*) FILTER (p_size % 4 = 3) AS unchanged FROM part""")
def reconcile_counters(v: Views) -> DataFrame:
    p = v.table("part").select("p_partkey", "p_name", "p_size")
    before = p.where("p_size % 4 != 2").select("p_partkey", F.when(F.col("p_size") % 4 == 1, F.concat(F.lit("old "), "p_name")).otherwise(F.col("p_name")).alias("p_name"))
    return upkeep.reconcile_counters(before, p.where("p_size % 4 != 0"), "p_partkey", "p_name")


@query("SELECT source AS root_id, doc_id, CASE WHEN source IN ('src1', 'src3') THEN upper(lang) ELSE lang END AS lang FROM documents WHERE NOT (source IN ('src1', 'src3') AND doc_id % 5 = 0)")
def scoped_recompute(v: Views) -> DataFrame:
    d = v.table("documents").select(F.col("source").alias("root_id"), "doc_id", "lang")
    touched = v.spark.createDataFrame([("src1",), ("src3",)], "root_id string")
    return upkeep.scoped_recompute(d, d.where("doc_id % 5 != 0").select("root_id", "doc_id", F.upper("lang").alias("lang")), touched)


@query(sql_with("symbols", """, l AS (SELECT arg_max(event_type <> 'error', event_id) AS completed FROM events), r AS (SELECT 'export_surface' AS surface, count(*) AS n FROM symbols WHERE doc_comment
IS NULL UNION ALL SELECT 'retired_observations', count(*) FROM part WHERE p_size % 10 = 0)
SELECT surface, n FROM r, l WHERE completed"""))
def auto_sync(v: Views) -> DataFrame:
    outcomes = v.events.select(F.col("event_id").alias("finished"), (F.col("event_type") != "error").alias("completed"))
    return upkeep.auto_sync(outcomes, [("export_surface", v.symbols.where("doc_comment IS NULL")), ("retired_observations", v.table("part").where("p_size % 10 = 0"))])


@query(sql_with("fingerprints " + ALL, DRIFT + f""", edges AS ({EDGES}), n(surface, severity, n) AS (
SELECT 'structural_refresh', 'actionable', (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) UNION ALL SELECT 'declared_links',
'actionable', (SELECT count(*) FROM edges WHERE kind = 'governs' AND dst NOT IN (SELECT 'part_' || p_partkey FROM part WHERE p_size <= 40))
UNION ALL SELECT 'commentary_overlay', 'actionable', (SELECT count(*) FROM conversations WHERE turn % 3 = 1) UNION ALL SELECT 'agent_notes', 'report_only', (SELECT
count(*) FROM conversations WHERE role = 'nobody') UNION ALL SELECT 'edge_drift', 'report_only', (SELECT count(*) FROM scores WHERE score >= 0.7)
UNION ALL SELECT 'retired_observations', 'actionable', (SELECT count(*) FROM part WHERE p_size % 10 = 0) UNION ALL SELECT 'proposed_links', 'report_only', (SELECT
count(*) FROM lineitem WHERE l_discount * 10 < 0.6) UNION ALL SELECT 'stale_rationale', 'report_only', (SELECT count(*) FROM scores WHERE score >= 0.5)
UNION ALL SELECT unnest(['writer_lock', 'store_maintenance', 'export_surface', 'legacy_installs']), NULL, 0)
SELECT surface, CASE WHEN severity IS NULL THEN 'unsupported' WHEN n = 0 THEN 'clean' ELSE severity END AS severity, n FROM n"""))
def repair_surfaces(v: Views) -> DataFrame:
    from ..operators import graph

    s = _scores(v)
    known = v.table("part").where("p_size <= 40").select(F.concat(F.lit("part_"), "p_partkey").alias("id"))
    c = v.table("conversations")
    return upkeep.repair_report({
        "structural_refresh": lifecycle.missing(v.table("orders").select("o_orderkey"), v.table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]),
        "declared_links": graph.dangling(v.edges("governs"), known), "commentary_overlay": c.where("turn % 3 = 1"), "agent_notes": c.where("role = 'nobody'"), "edge_drift": similarity.high_drift(s),
        "retired_observations": v.table("part").where("p_size % 10 = 0"), "proposed_links": v.table("lineitem").where(F.col("l_discount") * 10 < 0.6), "stale_rationale": s.where("score >= 0.5"),
    })


@query(f"SELECT event_id, {EVENT} AS event FROM events WHERE event_type NOT IN ('purchase', 'error') OR ts >= TIMESTAMP '2024-01-15'")
def retained_audit(v: Views) -> DataFrame:
    return upkeep.retained(_link_events(v).join(v.events.select(F.col("event_id").alias("seq"), "ts"), "seq"), "2024-01-15").select(F.col("seq").alias("event_id"), "event")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def retention(v: Views) -> DataFrame:
    return lifecycle.retention(v.events, "ts", "2024-01-20").select("event_id")


@query("SELECT event_type, 'k' AS key, sum((props->>'k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def props_sums(v: Views) -> DataFrame:
    return upkeep.key_sums(v.events.select("event_type", F.from_json("props", "map<string,bigint>").alias("props")), "event_type", "props")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (props->>'k')::BIGINT END AS k, CASE WHEN event_id % 2 = 0 THEN event_id END AS retired_at FROM events")
def json_patched(v: Views) -> DataFrame:
    p = F.from_json("props", "map<string,bigint>")
    changed = F.when(F.col("event_id") % 3 == 0, F.map_filter(p, lambda k, x: k != "k")).otherwise(p)
    set_ = F.when(F.col("event_id") % 2 == 0, F.map_concat(changed, F.create_map(F.lit("retired_at_rev"), "event_id"))).otherwise(changed)
    stored = v.events.select("event_id", F.to_json(set_).alias("json"))
    return stored.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"), F.get_json_object("json", "$.retired_at_rev").cast("long").alias("retired_at"))


@query("""WITH s AS (SELECT 'part_' || p_partkey AS id, p_size, p_retailprice AS score, CASE p_size % 4 WHEN 0 THEN 'active' ELSE 'rejected' END AS state FROM part), t AS (SELECT
id AS link, score / 2000 AS score, p_size AS generated FROM s WHERE state = 'active')
SELECT link, round(score, 6) AS score, generated FROM t WHERE score < 0.6 ORDER BY t.score DESC, generated DESC, link LIMIT 50""")
def overlay_candidates(v: Views) -> DataFrame:
    p = v.table("part").select(F.concat(F.lit("part_"), "p_partkey").alias("link"), F.when(F.col("p_size") % 4 == 0, "active").otherwise("rejected").alias("state"), (F.col("p_retailprice") / 2000).alias("score"), F.col("p_size").alias("generated"))
    return overlay.candidates(p, "below_threshold").select("link", F.round("score", 6).alias("score"), "generated")


@query("SELECT conv_id || ':' || turn AS note, turn AS updated FROM conversations WHERE role <> 'assistant' ORDER BY updated DESC, note LIMIT 50")
def visible_notes(v: Views) -> DataFrame:
    n = v.table("conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("note"), F.when(F.col("role") == "assistant", "forgotten").otherwise("active").alias("status"), F.col("turn").alias("updated"))
    return overlay.visible_notes(n).select("note", "updated")


@query("SELECT min(ts) AS oldest, max(ts) AS newest FROM events")
def commentary_range(v: Views) -> DataFrame:
    return overlay.commentary_range(v.events)


@query("""WITH m AS (SELECT event_type AS tool, count(value) AS n FROM events GROUP BY 1) SELECT 'lodestone_events_total{tool="' || tool || '"} ' || n AS line FROM m""")
def prometheus_lines(v: Views) -> DataFrame:
    return overlay.prometheus(overlay.metrics(v.events.select(F.col("event_type").alias("tool"), "value"))).where(F.col("line").contains("events_total"))


@query(sql_with("nodes " + ALL, f""", edges AS ({EDGES}), gone AS (SELECT 'part_' || p_partkey AS id FROM part WHERE p_size % 7 = 0) SELECT 'node:' || type AS what, count(*) AS n FROM nodes WHERE id NOT IN (FROM gone) GROUP BY 1
UNION ALL SELECT 'edge:' || kind, count(*) FROM edges WHERE src NOT IN (FROM gone) AND dst NOT IN (FROM gone) GROUP BY 1"""))
def delete_cascade(v: Views) -> DataFrame:
    from ..operators import graph

    gone = v.table("part").where("p_size % 7 = 0").select(F.concat(F.lit("part_"), "p_partkey").alias("id"))
    nodes, edges = lifecycle.cascade_delete(v.nodes, v.edges(), gone)
    return graph.graph_stats(nodes, edges)


@query("SELECT 'concept_' || item_id AS id FROM benchmark WHERE item_id % 3 = 0")
def missing_concepts(v: Views) -> DataFrame:
    c = v.table("benchmark").select(F.concat(F.lit("concept_"), "item_id").alias("id"), "item_id")
    return lifecycle.missing(c.select("id"), c.where("item_id % 3 != 0"), ["id"])


@query("SELECT event_id FROM events WHERE event_id % 4 <> 0")
def relevant_events(v: Views) -> DataFrame:
    path = F.when(F.col("event_id") % 8 == 0, "a/.git/x").when(F.col("event_id") % 8 == 4, "node_modules/y.js").otherwise("src/target.rs")
    return watch.relevant(v.events.select("event_id", path.alias("path"))).select("event_id")


@query("""SELECT 'part_' || p_partkey AS id, CASE WHEN p_size % 5 <> 0 THEN p_brand || '::' || p_type || '::' || p_name || chr(10) || p_name || chr(10) || p_type ELSE p_brand ||
'::' || p_type || '::' || p_name || chr(10) || p_name END AS text FROM part""")
def chunk_texts(v: Views) -> DataFrame:
    return sources.chunks(v.symbols)


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE coalesce(nullif(regexp_extract(substr(text, 1, 80), '(?s)^(.*) ', 1), ''), substr(text, 1, 80)) END AS cut FROM documents")
def cut_texts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", text.cut_at_word(F.col("text"), 80).alias("cut"))


@query("SELECT vec_id, len(embedding) AS dim FROM embeddings")
def stored_vectors(v: Views) -> DataFrame:
    """Vectors written with a check of their dimension and read back."""
    where = scratch.folder(v.spark, "vectors")
    sources.save_vectors(v.vectors, where, 64)
    return sources.load_vectors(v.spark, where, 64).select("vec_id", F.size("v").cast("long").alias("dim"))


@query(sql_with("lines", "SELECT root_id, count(*) AS n FROM lines GROUP BY root_id"))
def lexical_index(v: Views) -> DataFrame:
    """The index of lines, written by root and read back."""
    where = scratch.folder(v.spark, "lines")
    sources.save_index(v.lines, where)
    return v.spark.read.parquet(where).groupBy(F.col("root_id").cast("string").alias("root_id")).agg(F.count("*").alias("n"))


@query("SELECT source AS root_id, lang || '/' || doc_id AS path FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def united_roots(v: Views) -> DataFrame:
    f = v.files.select("root_id", "path", F.element_at(F.split("id", "_"), -1).cast("long").alias("k"))
    return sources.union_roots(f.where("k % 2 = 0"), f.where("k % 3 = 0")).select("root_id", "path")


@query("""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' ELSE 'rust' END AS l FROM pages), f AS (SELECT CASE l WHEN 'typescript' THEN
'web/m' || page_id || '/index.ts' WHEN 'python' THEN 'pkg/m' || page_id || '.py' ELSE 'src/m' || page_id || '/mod.rs' END AS path FROM p WHERE page_id % 2 = 0)
SELECT page_id, CASE l WHEN 'typescript' THEN 'web/m' || page_id || '/index.ts' WHEN 'python' THEN 'pkg/m' || page_id || '.py' ELSE 'src/m' || page_id || '/mod.rs' END AS resolved FROM p WHERE page_id % 2 = 0""")
def resolved_imports(v: Views) -> DataFrame:
    k = F.col("page_id")
    m = lambda a, b: F.concat(F.lit(a), k, F.lit(b))
    path = F.when(k % 3 == 0, m("web/m", "/index.ts")).when(k % 3 == 1, m("pkg/m", ".py")).otherwise(m("src/m", "/mod.rs"))
    asked = [("typescript", 0, "web/main.ts", m("./m", "")), ("python", 1, "main.py", m("pkg.m", "")), ("rust", 2, "src/main.rs", m("crate::m", ""))]
    refs = reduce(DataFrame.unionByName, [v.table("pages").where(k % 3 == r).select("page_id", F.lit(lang).alias("language"), F.lit(here).alias("path"), target.alias("target")) for lang, r, here, target in asked])
    found = parse.imported_files(refs, v.table("pages").where("page_id % 2 = 0").select(path.alias("path")))
    return refs.select("page_id", "path", "target").join(found, ["path", "target"]).select("page_id", "resolved")


TOKENS = f"list_slice(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) = 3 AND NOT list_contains({STOP}, x)), 1, 1 + turn % 2)"


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS} AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) = 2 THEN w[1] || '_' || w[2] || ';' || w[1] || ' ' || w[2] ELSE '' END AS phrases FROM t""")
def query_phrases(v: Views) -> DataFrame:
    w = F.slice(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: (F.length(x) == 3) & ~x.isin(*text.STOPWORDS)), F.lit(1), (F.col("turn") % 2 + 1).cast("int"))
    return v.table("conversations").select("conv_id", "turn", F.array_join(text.phrases(w), ";").alias("phrases"))


@query("SELECT event_id, event_id % 6 < 4 AS shaped FROM events")
def code_shapes(v: Views) -> DataFrame:
    shape = F.element_at(F.array(*map(F.lit, ("snake_case", "camelCase", "a::b", "HTTP2", "plain", "Title"))), (F.col("event_id") % 6 + 1).cast("int"))
    return v.events.select("event_id", text.code_shaped(shape).alias("shaped"))


@query("SELECT p_partkey, greatest(1, least(p_size, 40))::INT AS least FROM part WHERE p_size > 0 ORDER BY p_partkey LIMIT 40")
def clamped_limit(v: Views) -> DataFrame:
    return v.table("part").where("p_size > 0").select("p_partkey", F.greatest(F.lit(1), F.least("p_size", F.lit(40))).cast("int").alias("least")).orderBy("p_partkey").limit(budget.clamp(500, 1, 40))


#: Notes in markdown, made of items of the benchmark.
NOTE = """m AS (SELECT item_id, '---' || chr(10) || CASE WHEN item_id % 2 = 0 THEN 'title: "Note ' || item_id || '"' || chr(10) ELSE '' END || 'status: open' || chr(10) || CASE
WHEN item_id % 3 = 0 THEN 'aliases: [a' || item_id || ', ''b'']' ELSE 'aliases:' || chr(10) || '  - x' || item_id || chr(10) || '  - "y"' END || chr(10) || '---' ||
chr(10)
 || '# Heading ' || item_id || chr(10) || chr(10) || 'First  line' || chr(10) || 'of ' || item_id || '.' || chr(10) || chr(10) || CASE WHEN item_id % 5 < 3 THEN '## Decision' || chr(10) || 'We do ' || item_id || chr(10) || chr(10) || '## Next' || chr(10) || 'z' ELSE 'DECISION: keep ' || item_id || chr(10) || 'DECISION:   go' END AS t FROM benchmark)"""


def _markdown(v: Views) -> DataFrame:
    i = F.col("item_id").cast("string")
    k = F.col("item_id")
    head = F.concat(F.lit("---\n"), F.when(k % 2 == 0, F.concat(F.lit('title: "Note '), i, F.lit('"\n'))).otherwise(""), F.lit("status: open\n"), F.when(k % 3 == 0, F.concat(F.lit("aliases: [a"), i, F.lit(", 'b']"))).otherwise(F.concat(F.lit("aliases:\n  - x"), i, F.lit('\n  - "y"'))), F.lit("\n---\n"))
    rest = F.concat(F.lit("# Heading "), i, F.lit("\n\nFirst  line\nof "), i, F.lit(".\n\n"), F.when(k % 5 < 3, F.concat(F.lit("## Decision\nWe do "), i, F.lit("\n\n## Next\nz"))).otherwise(F.concat(F.lit("DECISION: keep "), i, F.lit("\nDECISION:   go"))))
    return v.table("benchmark").select("item_id", F.concat(head, rest).alias("t"))


@query(f"""WITH {NOTE} SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Note ' || item_id ELSE 'Heading ' || item_id END AS title, 'open' AS status, CASE WHEN item_id % 3 = 0 THEN
'a' || item_id || ',b' ELSE 'x' || item_id || ',y' END AS aliases, 'First line of ' || item_id || '.' AS summary,
CASE WHEN item_id % 5 < 3 THEN 'We do ' || item_id END AS decision, CASE WHEN item_id % 5 < 3 THEN '' ELSE 'keep ' || item_id || ';go' END AS markers FROM m""")
def markdown_notes(v: Views) -> DataFrame:
    t = F.col("t")
    return _markdown(v).select(
        "item_id", prose.title(t, F.lit("docs/x.md")).alias("title"), prose.front_scalar(t, "status").alias("status"), F.array_join(prose.front_list(t, "aliases"), ",").alias("aliases"),
        prose.summary(t).alias("summary"), prose.section(t, "Decision").alias("decision"), F.array_join(text.decision_markers(t), ";").alias("markers"),
    )


@query(f"WITH {NOTE} SELECT item_id, CASE WHEN item_id % 5 < 3 THEN 'We do ' || item_id ELSE regexp_extract(t, '(?s)\\n---\\n(.*)$', 1) END AS decision FROM m")
def decision_bodies(v: Views) -> DataFrame:
    return _markdown(v).select("item_id", prose.decision(F.col("t")).alias("decision"))


@query("SELECT conv_id, turn, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS t FROM conversations")
def normalised_texts(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", text.normalised(F.col("text")).alias("t"))


@query("""SELECT doc_id, greatest(strlen(text) // 3, 1)::BIGINT AS raw, round(CASE WHEN greatest(strlen(text) // 3, 1) > 60 THEN (greatest(strlen(text) // 3, 1) - 60) /
greatest(strlen(text) // 3, 1) ELSE 0 END, 6)::DOUBLE AS saved FROM documents""")
def card_savings(v: Views) -> DataFrame:
    raw = text.token_estimate(F.col("text")).cast("long")
    return v.table("documents").select("doc_id", raw.alias("raw"), F.round(text.savings_ratio(raw, F.lit(60)), 6).alias("saved"))


EXTENSIONS = ("rs", "py", "ts", "tsx", "go", "jsx", "java", "kts", "cs", "php", "rb", "swift", "h", "hpp", "dart", "txt")


@query("""SELECT event_id, ['rust', 'python', 'typescript', 'tsx', 'go', 'javascript', 'java', 'kotlin', 'csharp', 'php', 'ruby', 'swift', 'c', 'cpp', 'dart', NULL][event_id % 16 +
1] AS language, event_id % 5 IN (0, 1, 2, 3) AS test, event_id % 4 = 0 AS inside FROM events""")
def path_classes(v: Views) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % len(xs) + 1).cast("int"))
    test = pick(("a/tests/b.rs", "a/__tests__/b.ts", "x_test.go", "a.spec.ts", "src/contest.rs"))
    return v.events.select("event_id", text.language_of(F.concat(F.lit("Dir/File."), pick(EXTENSIONS))).alias("language"), text.is_test_path(test).alias("test"), text.within_root(pick(("src/a.rs", "srcs/a.rs", "lib/src/a", "s")), "src").alias("inside"))


@query(sql_with("files", "SELECT path FROM files WHERE regexp_matches(path, '^(en|fr)/[^/]*[13]$')"))
def matched_paths(v: Views) -> DataFrame:
    return v.files.where(text.path_matches(F.col("path"), "{en,fr}/*[13]")).select("path")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'invalid' WHEN 1 THEN 'fresh' WHEN 2 THEN 'stale' ELSE 'invalid' END AS freshness FROM events")
def commentary_freshness(v: Views) -> DataFrame:
    k = F.col("event_id") % 4
    return v.events.select("event_id", overlay.commentary_freshness(F.when(k == 0, "").otherwise("a"), F.when(k == 1, "a").when(k == 2, "b").when(k == 0, "a")).alias("freshness"))


@query(sql_with("nodes defines", "SELECT 'graph-json' AS form, (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM defines) AS n_edges, (SELECT count(*) FROM nodes) + (SELECT count(*) FROM defines) AS n_lines"))
def graph_manifest(v: Views) -> DataFrame:
    where = scratch.folder(v.spark, "graph")
    manifest = sources.export_graph(v.nodes, v.edges("defines"), where, "graph-json")
    return manifest.crossJoin(v.spark.read.json(where).where("what IS NOT NULL").agg(F.count("*").alias("n_lines")))


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey + 1 AS n FROM part WHERE p_partkey + 1 IN (SELECT p_partkey FROM part)) SELECT * FROM (
SELECT 'pkg/a' || k % 10 || '/m' || k || '.py' AS path, '..a' || n % 10 || '.m' || n AS target, 'pkg/a' || n % 10 || '/m' || n || '.py' AS resolved FROM p
UNION ALL SELECT 'crates/c/src/a' || k % 10 || '/m' || k || '.rs', 'super::super::a' || n % 10 || '::m' || n || '::Item', 'crates/c/src/a' || n % 10 || '/m' || n || '.rs' FROM p
UNION ALL SELECT 'svc/g' || k || '/m.go', 'example.com/svc/g' || n, 'svc/g' || n || '/m.go' FROM p)""")
def module_imports(v: Views) -> DataFrame:
    """Relative imports of python and rust, and Go imports by the module of their go.mod: each file imports the one of the next number."""
    k, n = F.col("p_partkey"), F.col("p_partkey") + 1
    join = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    kinds = (("python", join("pkg/a", k % 10, "/m", k, ".py"), join("..a", n % 10, ".m", n)), ("rust", join("crates/c/src/a", k % 10, "/m", k, ".rs"), join("super::super::a", n % 10, "::m", n, "::Item")), ("go", join("svc/g", k, "/m.go"), join("example.com/svc/g", n)))
    refs = reduce(DataFrame.unionByName, [v.table("part").select(F.lit(lang).alias("language"), path.alias("path"), target.alias("target")) for lang, path, target in kinds])
    mod = v.spark.range(1).select(F.lit("svc/go.mod").alias("path"), F.lit("module example.com/svc\n\ngo 1.22\n").alias("content"))
    return parse.imported_files(refs, refs.select("path"), parse.go_modules(mod))


@query("SELECT event_id, event_id % 6 IN (0, 1, 4) AS ignored FROM events")
def ignored_paths(v: Views) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("target/a.rs", "x/b.log", "x/keep.log", "src/target.rs", "docs/private/n.md", "a/docs/private/n.md"))), (F.col("event_id") % 6 + 1).cast("int"))
    return v.events.select("event_id", sources.ignored(path, ("# build", "target/", "*.log", "!keep.log", "/docs/private")).alias("ignored"))


@query("""WITH b AS (SELECT event_type AS tool, user_id % 7 AS part, sum(value) AS total, max(value) AS worst FROM events GROUP BY ALL), k AS (SELECT tool, 'u' || part AS key, total FROM b)
SELECT b.tool, round(sum(b.total), 6) AS total, max(worst) AS worst, (SELECT string_agg(key || '=' || round(total, 2), ',' ORDER BY key) FROM k WHERE k.tool = b.tool) AS by_user FROM b GROUP BY b.tool""")
def merged_metrics(v: Views) -> DataFrame:
    part = v.events.groupBy(F.col("event_type").alias("tool"), (F.col("user_id") % 7).alias("part")).agg(F.sum("value").alias("total"), F.max("value").alias("worst"))
    nested = upkeep.key_sums(part.select("tool", F.create_map(F.concat(F.lit("u"), "part"), "total").alias("m")), "tool", "m")
    by = nested.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_list(F.concat("key", F.lit("="), F.round("total", 2).cast("string")))), ",").alias("by_user"))
    return part.groupBy("tool").agg(F.round(F.sum("total"), 6).alias("total"), F.max("worst").alias("worst")).join(by, "tool")


@query(sql_with("lines", "SELECT path, line_number::INT AS line_number FROM lines WHERE root_id = 'src2' AND contains(line, 'the')"))
def branch_search(v: Views) -> DataFrame:
    """A search of one branch reads the folder of its index alone."""
    where = scratch.folder(v.spark, "branches")
    sources.save_index(v.lines.withColumn("root_id", F.concat("root_id", F.lit("@main"))), where)
    held = v.spark.read.parquet(where).where(F.col("root_id") == "src2@main")
    return held.where(F.col("line").contains("the")).select("path", F.col("line_number").cast("int").alias("line_number"))
