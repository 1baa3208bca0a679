"""N-gram Jaccard join with Bayesian candidate pruning."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, read, text_of
from .graph import components
from .numbers import U64, hash_words, mix, parts, runs

#: Bands of ROWS MinHash values; two sets of Jaccard 0.8 share no band with probability 1.3e-7.
BANDS, ROWS = 40, 5
#: MinHash values compared before the posterior is looked at again.
STEP = 20
#: A tile compares blocks of at most this many sets and about this many shingles each.
BLOCK_SETS, BLOCK_SHINGLES = 2048, 2_000_000

#: Bytes of text hashed at a time.
BATCH = 2 << 20

_RNG = np.random.default_rng(97)
_A = _RNG.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; a shorter text is one run of all its words."""
    (h,), first = hash_words(texts)
    r = runs(h, n)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(r[a : b - n + 1]))
        else:
            out.append(runs(h[a:b], int(b - a), 6) ^ U64(b - a) if b > a else np.zeros(0, U64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS MinHash values of a set that isn't empty, in parts of bounded size."""
    x = (shingles >> U64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096, None] * _A + _B).min(axis=0), out=out)
    return out


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(U64)
    key = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, k])
    return key


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, BATCH):
            sets = shingle_sets(b.column("text"), n)
            known = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            bands = [_bands(signature(s)).astype(np.int64) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(known, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc", "set", "size", "bands"])

    return run


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For n = STEP, 2 * STEP, ..: the fewest matches of n MinHash values with which a pair stays.

    With a uniform prior, P(J >= t | m of n match) is the probability that a binomial of
    n + 1 trials of chance t gives m at most.
    """
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return tuple(out)


def exact_shingles(texts: list[str], n: int) -> list[np.ndarray]:
    """The shingles of each text as sorted distinct numbers that are equal if and only if the shingles are, word for word."""
    known: defaultdict[bytes, int] = defaultdict()
    known.default_factory = known.__len__  # a new word gets the next number
    coded, short = [], {}
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split()
        coded.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    code = np.concatenate([*coded, np.zeros(0, np.int64)])
    first = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int64)
    ids, vocabulary = code, len(known) + 1
    for k in range(1, n):  # runs of k + 1 words: a run of k words and the next one, numbered anew
        pairs = ids[: max(len(code) - k, 0)] * vocabulary + code[k:]
        ids = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
    out = []
    for c, a, b in zip(coded, first[:-1], first[1:]):
        if len(c) >= n:
            out.append(np.unique(ids[a : b - n + 1]))
        else:
            out.append(np.array([-1 - short.setdefault(tuple(c), len(short))], np.int64) if len(c) else np.zeros(0, np.int64))
    return out


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of the pairs, by products of incidence rows if there are many."""
    if len(i) < 2 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[col] > 1
    owner, col = owner[shared], np.unique(col[shared], return_inverse=True)[1]
    product, order = np.zeros((len(sets), len(sets)), np.float32), np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    wide = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, wide):
        a, b = np.searchsorted(col, (lo, lo + wide))
        part = np.zeros((len(sets), wide), np.float32)
        part[owner[a:b], col[a:b] - lo] = 1
        product += part @ part.T
    return product[i, j].astype(np.int64)


def likely_pairs(sig: np.ndarray, size: np.ndarray, side: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that may be of ``threshold`` similarity: all pairs of a block's own tile (side -1), else only pairs across, of which a tile with an empty block has none.

    MinHash values are compared STEP at a time, and pairs whose posterior probability falls under ``tolerance`` go.
    """
    if side[0] >= 0:
        i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side == 0), np.flatnonzero(side == 1), indexing="ij"))
    else:
        i, j = np.triu_indices(len(size), 1)
    near = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
    i, j = i[near], j[near]
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        at = slice(k * STEP, (k + 1) * STEP)
        for lo in range(0, len(i), 1 << 16):
            part = slice(lo, lo + (1 << 16))
            matches[part] += (sig[i[part], at] == sig[j[part], at]).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        i, j, matches = i[keep], j[keep], matches[keep]
    return i, j


def linked_pairs(texts: list[str], side: np.ndarray, n: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the texts whose Jaccard similarity is ``threshold`` at least, among those that ``likely_pairs`` leaves; these are held against each other word for word."""
    if side[0] >= 0 and (side == side[0]).all():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sig, size = [], []
    for lo in range(0, len(texts), 64):
        for s in shingle_sets(pa.array(texts[lo : lo + 64], pa.large_string()), n):
            sig.append(signature(s))
            size.append(len(s))
    i, j = likely_pairs(np.stack(sig), np.array(size, np.int64), side, threshold, tolerance)
    if not len(i):
        return i, j
    some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    sets = exact_shingles([texts[k] for k in some], n)
    both = _overlaps(sets, at[: len(i)], at[len(i) :])
    real = np.array([len(s) for s in sets], np.int64)
    sure = both >= threshold * (real[at[: len(i)]] + real[at[len(i) :]] - both) - 1e-9
    return i[sure], j[sure]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least of the indices that pairs connect to each."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, i, root[j])
        np.minimum.at(low, j, root[i])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _tile(rows: list[tuple], n: int, threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(node, least node linked within the tile, links) of the sets that have any; rows of (node, copies, side, text)."""
    node, copies, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows])
    i, j = linked_pairs([r[3] for r in rows], side, n, threshold, tolerance)
    links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
    root = _roots(len(rows), i, j)
    return [(int(node[k]), int(node[root[k]]), int(links[k])) for k in np.flatnonzero(links)]


def _tiles(n: int, threshold: float, tolerance: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, rows, out = None, [], []
        for b in batches:
            for tile, node, copies, side, text in zip(b["tile"], b["node"], b["copies"], b["side"], b["text"]):
                if tile != open_:
                    out += _tile(rows, n, threshold, tolerance) if len(rows) > 1 else []
                    open_, rows = tile, []
                rows.append((node, copies, side, text))
            if len(out) > 10000:
                yield pd.DataFrame(out, columns=["node", "other", "links"])
                out = []
        out += _tile(rows, n, threshold, tolerance) if len(rows) > 1 else []
        yield pd.DataFrame(out, columns=["node", "other", "links"]).astype("int64")

    return run


def _likely(threshold: float, tolerance: float):
    """Within each part of a bucket, sorted by it: (u, v) from each set to the least one that likely pairs connect it to."""

    def judged(rows: list[tuple]) -> list[tuple[int, int]]:
        node, side, size = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], np.int64)
        if side[0] >= 0 and (side == side[0]).all():
            return []
        root = _roots(len(rows), *likely_pairs(np.frombuffer(b"".join(r[3] for r in rows), "<u2").reshape(len(rows), -1), size, side, threshold, tolerance))
        return [(int(node[k]), int(node[root[k]])) for k in np.flatnonzero(root != np.arange(len(rows)))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, rows = None, []
        for b in batches:
            out = []
            for part, node, side, size, sig in zip(b["part"], b["node"], b["side"], b["size"], b["sig"]):
                if part != open_:
                    out += judged(rows) if len(rows) > 1 else []
                    open_, rows = part, []
                rows.append((node, side, size, sig))
            yield pd.DataFrame(out, columns=["u", "v"]).astype("int64")
        yield pd.DataFrame(judged(rows) if len(rows) > 1 else [], columns=["u", "v"]).astype("int64")

    return run


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, BATCH):
            sig = pa.array([signature(s).astype("<u2").tobytes() for s in shingle_sets(b.column("text"), n)], pa.binary())  # the lower halves: those that differ seem equal once in 65,536
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("size"), b.column("shared"), sig], names=["node", "size", "shared", "sig"])

    return run


def refined(keyed: DataFrame, sets: DataFrame, band: DataFrame, comp: DataFrame, n: int, threshold: float, tolerance: float) -> DataFrame:
    """``comp`` (node, root), where components too large for a tile are cut to what likely pairs connect.

    Weak likeness chains buckets of the same band into components far larger than any class.  So in each bucket
    of such a component MinHash values are compared pair by pair, and only pairs that may reach the threshold connect;
    a bucket of more than BLOCK_SETS sets is compared block by block.  Buckets that hold the same sets, told by 128 bits, are
    compared once.  Signatures travel, not texts, and a part of a bucket returns one edge a set.
    """
    sizes = sets.select("node", "size")
    large = comp.join(sizes, "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("w")).where((F.col("n") > BLOCK_SETS) | (F.col("w") > BLOCK_SHINGLES)).select("root")
    inside = durable(comp.join(large, "root").select("node", "root"), "jaccard-large")
    if not inside.head(1):
        return comp
    own = band.join(inside.select("node"), "node", "left_semi")
    full = own.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("y")).where("n > 1")
    full = full.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / BLOCK_SETS).cast("int").alias("blocks"))
    shared = own.join(full, "band").groupBy("node").agg(F.collect_list(F.struct("band", "blocks")).alias("shared"))
    texts = keyed.join(sets.join(shared, "node").select("doc", "node", "size", "shared").hint("merge"), "doc").dropDuplicates(["node"]).select("node", "size", "shared", "text")
    signed = texts.mapInArrow(_signed(n), "node long, size int, shared array<struct<band:bigint,blocks:int>>, sig binary")
    each = signed.select("node", "size", "sig", F.explode("shared").alias("s")).select("node", "size", "sig", "s.band", F.col("s.blocks").alias("blocks"), F.pmod(F.xxhash64("node", F.lit(5)), F.col("s.blocks")).cast("int").alias("block"))
    dealt = each.select("node", "size", "sig", F.explode(_dealt(F.col("blocks"), F.col("block"), lambda i, j: F.xxhash64("band", i, j))).alias("t")).select(F.col("t.tile").alias("part"), "node", F.col("t.side").alias("side"), "size", "sig")
    edges = dealt.repartition("part").sortWithinPartitions("part").mapInPandas(_likely(threshold, tolerance), "u long, v long")
    tight = components(durable(edges, "jaccard-likely"), "jaccard-refined")
    return comp.join(inside.select("node"), "node", "left_anti").select("node", "root").unionByName(tight.select("node", "root"))


def _dealt(blocks: Column, block: Column, tile) -> Column:
    """The tiles of a set of one of ``blocks`` blocks: one with each other block, as side 0 or 1, and the block's own, as side -1."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(tile(F.least(block, j), F.greatest(block, j)).alias("tile"), F.when(block == j, -1).when(block > j, 1).otherwise(0).alias("side")))


def tiled(sets: DataFrame, comp: DataFrame) -> DataFrame:
    """doc, node, copies, tiles: each set's candidates meet it in one of its tiles.

    The sets of a component that is too large for a tile are classed by size, so that sets of
    the asked similarity are in one class or in neighbours, and a class is dealt into blocks;
    a tile holds two blocks, as sides 0 and 1, or is a block's own, as side -1.
    """
    c = comp.join(sets.select("node", "doc", "size", "copies"), "node")
    total = c.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    small = (F.col("n") <= BLOCK_SETS) & (F.col("w") <= BLOCK_SHINGLES)
    c = c.join(total.select("root", small.alias("small")), "root")
    c = c.select("node", "doc", "copies", "size", "root", F.when(F.col("small"), -1).otherwise(F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / math.log(1.25))).cast("int").alias("cls"))
    cls = c.groupBy("root", "cls").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cls = cls.withColumn("blocks", F.when(F.col("cls") < 0, 1).otherwise(F.col("blocks")))
    above = cls.select("root", (F.col("cls") - 1).alias("cls"), F.col("blocks").alias("above")).where("cls >= 0")
    below = cls.select("root", (F.col("cls") + 1).alias("cls"), F.col("blocks").alias("below")).where("cls > 0")
    cls = cls.join(above, ["root", "cls"], "left").join(below, ["root", "cls"], "left")
    c = c.join(cls, ["root", "cls"]).select("*", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int").alias("block"))
    tile = lambda a, b, i, j: F.xxhash64("root", a, b, i, j)
    k, up = F.col("cls"), F.col("cls") + 1
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    own = _dealt(F.col("blocks"), F.col("block"), lambda i, j: tile(k, k, i, j))
    higher = F.transform(upto(F.col("above")), lambda j: F.struct(tile(k, up, F.col("block"), j).alias("tile"), F.lit(0).alias("side")))
    lower = F.transform(upto(F.col("below")), lambda j: F.struct(tile(k - 1, k, j, F.col("block")).alias("tile"), F.lit(1).alias("side")))
    return c.select("doc", "node", "copies", F.concat(own, higher, lower).alias("tiles"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What tells rows apart that share an id but not a text, and takes null ids."""
    return F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"))


def jaccard_classes(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, first, class_id, n_links of each row: its class is what links of ``threshold`` or more connect.

    first is the least doc of the class, class_id its least doc_id, n_links the number of other
    rows of that similarity.  Rows of one shingle set are a node, by a 128-bit digest of the set, and are not
    compared.  Nodes that share a band of MinHash values are candidates; what candidates
    connect is compared tile by tile, after ``refined`` has cut what is too large for a tile: MinHash values STEP at a time, dropping pairs
    whose posterior probability of reaching ``threshold`` is under ``tolerance``, and in
    the end word for word.  A tile gives its nodes' number of links and their least link, not the pairs.

    Nulls: a null text is empty; a text without words has no links and is its own class; a
    text of fewer than ``n`` words is one shingle.  A null id doesn't name a class that has
    another.  Repeated rows are links of each other.  An empty table gives no rows.  Other
    columns aren't read.
    """
    text = text_of(text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    keyed = docs.select(row_key(id_col, text_col).alias("doc"), text.alias("text"))
    key = f"struct<doc_id:{kind},text_hash:bigint>"
    seen = durable(keyed.mapInArrow(_sketch(n), f"doc {key}, set binary, size int, bands array<long>"), "jaccard-sketches")
    grouped = seen.where("set IS NOT NULL").groupBy("set").agg(F.min("doc").alias("doc"), F.min("doc.doc_id").alias("least"), F.first("size").alias("size"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    sets = durable(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "jaccard-sets")
    band = sets.select("node", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band", "low")
    comp = components(band.join(shared, "band").select(F.col("node").alias("u"), F.col("low").alias("v")), "jaccard-candidates")
    comp = refined(keyed, sets, band, comp, n, threshold, tolerance)
    placed = durable(tiled(sets, comp), "jaccard-tiles")
    held = keyed.join(placed.hint("merge"), "doc").dropDuplicates(["node"]).select("node", "copies", "text", F.explode("tiles").alias("t"))
    dealt = held.select("t.tile", "node", "copies", "t.side", "text").repartition("tile").sortWithinPartitions("tile")
    links = durable(dealt.mapInPandas(_tiles(n, threshold, tolerance), "node long, other long, links long"), "jaccard-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(links.select(F.col("node").alias("u"), F.col("other").alias("v")), "jaccard-classes")
    node = sets.select("node", "set", "doc", "least", "copies").join(roots, "node", "left").join(counts, "node", "left").select("set", "doc", "least", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    least = node.groupBy("root").agg(F.min("least").alias("class_id"), F.min("doc").alias("first"))
    node = node.drop("doc").join(least, "root").select("set", "first", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return seen.select("doc", "set").join(node, "set", "left").select("doc", F.coalesce("first", "doc").alias("first"), F.coalesce("class_id", "doc.doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id, n_links of each row, as ``jaccard_classes`` finds and defines them."""
    return jaccard_classes(docs, **options).select("doc.doc_id", "class_id", "n_links")


def keep_one_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, that of the least id, with the columns of ``docs`` whatever their names.

    Nulls: a null id comes first among those of a class; a null text is empty, and null and empty texts stay, but for
    repeated rows.  Of rows with one id and text one stays.  An empty table gives no rows.
    """
    first = jaccard_classes(docs, **options).where("doc = first").select(F.col("doc").alias("__doc")).distinct()
    return docs.select(row_key().alias("__doc"), *[F.col(c) for c in docs.columns]).join(first, "__doc", "left_semi").dropDuplicates(["__doc"]).drop("__doc")


def op4_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_n FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM b JOIN n a ON a.doc_id = u JOIN n c ON c.doc_id = v WHERE both_n * 10 >= 8 * (a.n + c.n - both_n)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
c AS (SELECT DISTINCT u AS doc_id, u AS root FROM e UNION SELECT e.v, c.root FROM c JOIN e ON e.u = c.doc_id)
SELECT d.doc_id, coalesce(r.root, d.doc_id) AS class_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM d LEFT JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) r USING (doc_id) LEFT JOIN (SELECT u AS doc_id, count(*) AS n FROM e GROUP BY u) k USING (doc_id)
"""
