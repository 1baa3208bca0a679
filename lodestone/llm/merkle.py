"""Merkle manifest of a dataset: levels as strings of fixed-width digests, one tree a language and one over their roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, let, read
from .repair import CRC32_SQL

#: Nodes under one parent, characters of a digest, levels that one aligned block holds and nodes it starts from.
FAN, WIDTH, DEPTH = 8, 64, 3
BLOCK = FAN**DEPTH

LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(*values: Column) -> Column:
    """Digest of values, each ``-`` if null, else its length in bytes, a colon and its text."""
    parts = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in (x.cast("string") for x in values)]
    return digest(F.concat(*parts))


def tampered(text: Column, id_: Column) -> Column:
    """``text`` with A-Z lower-cased where 3 divides crc32 of the id; null elsewhere."""
    return F.when(F.crc32(id_.cast("string")) % 3 == 0, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def ranked(rows: DataFrame, group: str, order: list[str], tag: str) -> tuple[DataFrame, int]:
    """``rows`` with pos, their place from 0 in their group (null: a group) by ``order``, nulls first, and n, its size; the largest n.

    Rows are dealt by range of (group, order), so a hot group spreads over tasks; only the number
    of rows by group and range is summed up.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    dealt = durable(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), tag)
    runs = dealt.groupBy(F.col(group).alias("r_group"), F.col("part").alias("r_part")).agg(F.min("at").alias("first"), F.count("*").alias("in_part"))
    w = Window.partitionBy("r_group")
    before = F.sum("in_part").over(w.orderBy("r_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_part")
    runs = durable(runs.select("r_group", "r_part", "first", before.alias("before"), F.sum("in_part").over(w).alias("n")), f"{tag}-runs")
    met = dealt.join(runs, dealt[group].eqNullSafe(runs["r_group"]) & (dealt["part"] == runs["r_part"]))
    return met.select(*rows.columns, (F.col("before") + F.col("at") - F.col("first")).alias("pos"), "n"), runs.agg(F.max("n")).first()[0] or 0


def rounds_for(n: int) -> int:
    """How often blocks are formed until one node is left of ``n``; once at least."""
    rounds, n = 1, -(-n // BLOCK)
    while n > 1:
        n, rounds = -(-n // BLOCK), rounds + 1
    return rounds


def _levels(level0: Column, height: Column) -> Column:
    """The strings of DEPTH + 1 levels of a block; a level above ``height`` repeats the one below it."""

    def above(level: Column, k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (F.length(level) - 1).cast("int"), F.lit(FAN * WIDTH)), lambda i: digest(F.substring(level, i + 1, FAN * WIDTH)))
        return F.when(height > k, F.array_join(runs, "")).otherwise(level)

    def grow(levels: Column, k: int) -> Column:
        if k == DEPTH:
            return levels
        return let(levels, lambda held: grow(F.concat(held, F.array(above(held[k], k))), k + 1))

    return grow(F.array(level0), 0)


def _flanks(level: Column, at: Column) -> Column:
    """What stands left and right of digest number ``at`` in its run: two substrings."""
    inside = at % FAN
    left = F.substring(level, (at - inside) * WIDTH + 1, inside * WIDTH)
    right = F.substring(level, (at + 1) * WIDTH + 1, (FAN - 1 - inside) * WIDTH)
    return F.struct(left.alias("l"), right.alias("r"))


def _blocks(nodes: DataFrame, tag: str) -> DataFrame:
    """Nodes (grp, pos, hash, n, load) of an aligned block in one row: grp, block, n, items, levels."""
    height = sum((F.when(F.col("n") > FAN**k, 1).otherwise(0) for k in range(DEPTH)), F.lit(0))
    met = nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("pos") % BLOCK).cast("int").alias("at"), "hash", "load"))).alias("items"))
    met = met.select("grp", "block", "n", "items", height.alias("height"), F.array_join(F.col("items.hash"), "").alias("level0"))
    return durable(met.select("grp", "block", "n", "items", "height", _levels(F.col("level0"), F.col("height")).alias("levels")), tag)


def build_tree(nodes: DataFrame, most: int, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, from the leaves up, and the root (grp, root) of each group of ``nodes``, the largest of ``most`` nodes.

    A block of 512 nodes holds three levels as strings; its last one is one digest, a node of the
    next round.  Where a group has one block, only as many levels are formed as it takes.
    """
    held = []
    for k in range(rounds_for(most)):
        held.append(_blocks(nodes, f"{tag}-{k}"))
        nodes = held[-1].select("grp", F.col("block").alias("pos"), F.col("levels")[DEPTH].alias("hash"), F.ceil(F.col("n") / BLOCK).alias("n"), F.lit(None).cast("string").alias("load"))
    return held, nodes.select("grp", F.col("hash").alias("root"))


def proofs(held: list[DataFrame], tops: DataFrame) -> DataFrame:
    """grp, pos, hash, load, path and the other columns of ``tops`` for each leaf of a tree of ``build_tree``.

    ``tops`` has for each group the path above its root.  Each round adds the flanking substrings of its levels.
    """
    more = [c for c in tops.columns if c not in ("grp", "path")]
    above = tops.select(F.col("grp").alias("a_grp"), F.lit(0).cast("long").alias("a_pos"), F.col("path").alias("a_path"), *more)
    for k, blocks in reversed(list(enumerate(held))):
        met = blocks.join(above, blocks["grp"].eqNullSafe(above["a_grp"]) & (blocks["block"] == above["a_pos"]))
        steps = lambda at: F.slice(F.array(*[_flanks(F.col("levels")[i], F.shiftright(at, 3 * i)) for i in range(DEPTH)]), F.lit(1), F.col("height"))
        items = F.transform("items", lambda x: F.struct(x["at"].alias("at"), x["hash"].alias("hash"), x["load"].alias("load"), steps(x["at"]).alias("steps")))
        each = met.select("grp", "block", F.explode(items).alias("x"), "a_path", *more)
        above = each.select(F.col("grp").alias("a_grp"), (F.col("block") * BLOCK + F.col("x.at")).alias("a_pos"), F.concat("x.steps", "a_path").alias("a_path"), *more, *([F.col("x.hash").alias("hash"), F.col("x.load").alias("load")] if k == 0 else []))
    return above.select(F.col("a_grp").alias("grp"), F.col("a_pos").alias("pos"), "hash", "load", F.col("a_path").alias("path"), *more)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["l"], node, s["r"])))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, changed, subroot, root and path (array of l, r) of each row of ``docs``.

    Leaves of a language ascend by doc_id; every eight consecutive nodes become their digest until
    one is left, the subroot; subroots in order of language likewise give the root.  A path lists,
    level by level, the digests left and right of the node in its run.  changed is the leaf of the
    tampered row, null where nothing is tampered.

    Nulls: a null in any column is ``-`` in its leaf; a null id comes first in its language and is
    never tampered with; a null language is a language of its own, the first.  Empty texts are
    ``0:``.  Texts of any length are hashed whole.  Rows of one id are ordered by leaf, equal rows
    are leaves of their own with one digest.  An empty table gives no rows.  Other columns aren't
    read, whatever their names.
    """
    kept = [F.col(c) for c in LEAF_COLUMNS]
    changed = tampered(F.col("text"), F.col("doc_id"))
    leaves = durable(docs.select("doc_id", "lang", leaf_of(*kept).alias("hash"), F.when(changed.isNotNull(), leaf_of(*kept[:-1], changed)).alias("changed")), "merkle-leaves")
    nodes, most = ranked(leaves, "lang", ["doc_id", "hash"], "merkle-order")
    held, roots = build_tree(nodes.select(F.col("lang").alias("grp"), "pos", "hash", "n", F.struct("doc_id", "changed").alias("load")), most, "merkle-docs")
    roots = durable(roots, "merkle-subroots")
    langs, most = ranked(roots.withColumn("all", F.lit(0)), "all", ["grp"], "merkle-langs")
    over, root = build_tree(langs.select(F.col("all").alias("grp"), "pos", F.col("root").alias("hash"), "n", F.struct(F.col("grp").alias("lang")).alias("load")), most, "merkle-top")
    steps = "array<struct<l:string,r:string>>"
    tops = proofs(over, root.withColumn("path", F.array().cast(steps)))
    tops = tops.select(F.col("load.lang").alias("grp"), F.col("hash").alias("subroot"), "root", "path")
    each = proofs(held, tops)
    return each.select("load.doc_id", F.col("grp").alias("lang"), F.col("hash").alias("leaf"), "load.changed", "subroot", "root", "path")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    each = manifest(read(spark, sf_dir, "documents"))
    each = each.withColumn("folded_root", fold(F.col("path"), F.coalesce("changed", "leaf")))
    proof = digest(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), ""))
    return each.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT *, doc_id::VARCHAR AS s FROM documents),
t AS (SELECT *, CASE WHEN {CRC32_SQL} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS changed FROM d),
v AS (SELECT doc_id, lang, changed, text, coalesce(octet_length(encode(s)) || ':' || s, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
             || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM t),
l AS (SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, CASE WHEN changed IS NOT NULL THEN sha256(head || octet_length(encode(changed)) || ':' || changed) END AS changed FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
up AS (
  SELECT 0 AS lvl, lang, pos, leaf AS h, n FROM o
  UNION ALL SELECT lvl + 1, lang, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM up WHERE n > 1 GROUP BY lvl, lang, pos // 8),
subroots AS (SELECT lang, max(lvl) AS height, max(h) FILTER (n = 1) AS subroot FROM up GROUP BY lang),
s AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM subroots),
over_all AS (
  SELECT 0 AS lvl, pos, subroot AS h, n FROM s
  UNION ALL SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 7) // 8) FROM over_all WHERE n > 1 GROUP BY lvl, pos // 8),
sides AS (
  SELECT a.lvl, a.lang, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM up a JOIN up b ON a.lvl = b.lvl AND a.lang IS NOT DISTINCT FROM b.lang AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lvl, a.lang, a.pos),
top_sides AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM over_all a JOIN over_all b ON a.lvl = b.lvl AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
steps AS (
  SELECT o.lang, o.pos AS leaf_pos, sides.lvl, sides.l, sides.r FROM o JOIN sides ON o.lang IS NOT DISTINCT FROM sides.lang AND sides.pos = o.pos // (8 ** sides.lvl)::BIGINT
  UNION ALL SELECT o.lang, o.pos, s.height + t.lvl, t.l, t.r FROM o JOIN s ON o.lang IS NOT DISTINCT FROM s.lang JOIN top_sides t ON t.pos = s.pos // (8 ** t.lvl)::BIGINT),
paths AS (SELECT lang, leaf_pos, list({{'l': l, 'r': r}} ORDER BY lvl) AS path FROM steps GROUP BY lang, leaf_pos),
folded AS (
  SELECT o.*, coalesce(path, []) AS path, list_reduce(list_prepend({{'l': coalesce(o.changed, o.leaf), 'r': ''}}, coalesce(path, [])), lambda a, b: {{'l': sha256(b.l || a.l || b.r), 'r': ''}}).l AS folded_root
  FROM o LEFT JOIN paths p ON o.lang IS NOT DISTINCT FROM p.lang AND o.pos = p.leaf_pos)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(path, lambda x: x.l || x.r), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN s ON folded.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT max(h) FILTER (n = 1) AS root FROM over_all)
"""
