"""Substring dedup with a count-min prefilter."""

from __future__ import annotations

import os
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import drop, durable, read, text_of
from .numbers import U64, Words, hash_words, inside, mix, parts, runs

#: A window is known in the sketch by its least run of ANCHOR words.
ANCHOR = 8
#: Rows of the sketch, and cells of one block of a row.
DEPTH, BLOCK = 2, 1 << 16
#: Bounds of the sketch's cells in all; a cell is a bit when it is broadcast, so 128 MB at most.
LEAST_CELLS, MOST_CELLS = 1 << 18, 1 << 30
#: Bytes of text that are hashed at a time; of the rest of a batch only cells or digests are held.
PIECE = 1 << 20
#: Cells of a row that a task gathers before it sends or counts them.
GATHERED = 1 << 20

_PLACE_BITS = 26
_PLACE = U64((1 << _PLACE_BITS) - 1)


def anchors(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, places, runs): of each window of ``size`` words within a text, where it starts and where its anchor does, and the hashes of all runs of ANCHOR words.

    The anchor is the window's run of least hash, the first of equals.  Equal windows have it
    at the same offset, so a window that starts at two places has an anchor that stands at two.
    """
    starts = np.flatnonzero(inside(first, size))
    short = min(ANCHOR, size)
    r = runs(h, short)
    if not len(starts):
        return starts, starts, r
    span, places, piece = size - short + 1, [], 1 << (_PLACE_BITS - 1)
    for lo in range(0, len(r) - span + 1, piece):  # a text may have more words than a place has bits
        part = r[lo : lo + piece + span - 1]
        low = (part & ~_PLACE) | np.arange(len(part), dtype=U64)
        width = 1
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        here = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + piece)] - lo
        places.append((np.minimum(low[here], low[here + span - width]) & _PLACE).astype(np.int64) + lo)
    return starts, np.concatenate(places), r


def _cells(run: np.ndarray, per_row: int) -> list[np.ndarray]:
    """The cell of each run in each row of the sketch."""
    one = mix(run)
    return [((one >> U64(32 * k)) & U64(0xFFFFFFFF)) * U64(per_row) >> U64(32) for k in range(DEPTH)]


def _by_block(found: list[list[np.ndarray]]) -> pa.RecordBatch:
    """By row and block the cells in ``found``, as sorted numbers, one that counts two or more twice."""
    rows, blocks, cells = [], [], []
    for k in range(DEPTH):
        c = np.sort(np.concatenate([x[k] for x in found]))
        c = c[np.concatenate([[True] * min(2, len(c)), c[2:] != c[:-2]])]  # two of each at most
        block, low = c >> 16, (c & (BLOCK - 1)).astype("<u2")
        cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for i, j in zip(cut, [*cut[1:], len(c)]):
            rows.append(k)
            blocks.append(int(block[i]))
            cells.append(low[i:j].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blocks, pa.int32()), pa.array(cells, pa.binary())], names=["row", "block", "cells"])


def _sketch(size: int, per_row: int):
    """A partition's sketch by row and block, a piece of about GATHERED anchors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for piece in parts(batches, PIECE):
            (h,), first = hash_words(piece.column("text"))
            starts, place, r = anchors(h, first, size)
            if not len(starts):
                continue
            at = place[np.concatenate([[True], place[1:] != place[:-1]])]
            found.append([c.astype(np.uint32) for c in _cells(r[at], per_row)])
            n += len(at)
            if n >= GATHERED:
                yield _by_block(found)
                found, n = [], 0
        if found:
            yield _by_block(found)

    return run


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted by row and block: the sum of the sketches, as bits of cells that count two or more.

    The cells of a block are gathered and counted at once, so a row costs no pass over all cells of its block.
    """
    open_, count, found, n = None, np.zeros(BLOCK, np.uint8), [], 0

    def add():
        nonlocal count, found, n
        if found:
            count = np.minimum(count + np.bincount(np.frombuffer(b"".join(found), "<u2"), minlength=BLOCK), 2).astype(np.uint8)
        found, n = [], 0

    for b in batches:
        out = []
        for row, block, cells in zip(b["row"], b["block"], b["cells"]):
            if (row, block) != open_:
                if open_ is not None:
                    add()
                    out.append((*open_, np.packbits(count >= 2).tobytes()))
                open_, count = (row, block), np.zeros(BLOCK, np.uint8)
            found.append(cells)
            n += len(cells) // 2
            if n >= GATHERED:
                add()
        yield pd.DataFrame(out, columns=["row", "block", "bits"])
    if open_ is not None:
        add()
        yield pd.DataFrame([(*open_, np.packbits(count >= 2).tobytes())], columns=["row", "block", "bits"])


def _firsts(h: np.ndarray, g: np.ndarray, row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which of the windows of a batch aren't preceded in it; they come by row and start.

    The same window earlier in the row precedes it, and in a row whose document ranks before.
    """
    order = np.lexsort((rank, g, h))  # stable
    h, g, row, rank = h[order], g[order], row[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    least = rank[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else rank
    own = np.ones(len(h), bool)
    own[1:] = new[1:] | (row[1:] != row[:-1])
    out = np.empty(len(h), bool)
    out[order] = own & (rank == least)
    return out


_DIGEST = np.dtype([("h", "<i8"), ("g", "<i4")])


def _seen(texts: pa.Array, size: int, per_row: int, flags: list[np.ndarray], salt: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(digests, rows, starts) of the windows in ``texts`` whose anchors the sketch counts twice or more, by row and start."""
    words = Words(texts)
    starts, place, r = anchors(words.hashes(), words.first, size)
    ok = np.ones(len(starts), bool)
    for k, c in enumerate(_cells(r[place], per_row)):
        ok &= (flags[k][c >> U64(3)] >> (U64(7) - (c & U64(7))).astype(np.uint8)) & 1 == 1
    starts = starts[ok]
    if not len(starts):
        return None
    known = np.frombuffer(b"".join([blake2b(w, digest_size=12, salt=salt).digest() for w in words.windows(starts, size)]), _DIGEST)
    row = np.searchsorted(words.first, starts, side="right") - 1
    return known, row.astype(np.int32), (starts - words.first[row]).astype(np.int32)


def _repeated(size: int, per_row: int, bits, salt: bytes):
    """The windows whose anchors the sketch counts twice or more, each by a salted BLAKE2b digest of its words, 96 bits.

    Those preceded within the batch are known to go and leave without it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bits.value
        for b in parts(batches):
            found, at = [], 0
            for piece in parts(iter([b]), PIECE):
                if (x := _seen(piece.column("text"), size, per_row, flags, salt)) is not None:
                    found.append((x[0], x[1] + np.int32(at), x[2]))
                at += piece.num_rows
            if not found:
                continue
            known, row, start = (np.concatenate([x[k] for x in found]) for k in range(3))
            del found
            _, rank = np.unique(b.column("d").to_numpy(zero_copy_only=False), return_inverse=True)
            kept = _firsts(known["h"], known["g"], row, rank.astype(np.int32)[row])
            for i in range(0, len(start), 100_000):
                part = slice(i, i + 100_000)
                k, on = known[part], kept[part]
                here = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.where(on, k["h"], 0)), pa.array(np.where(on, k["g"], 0)), b.column("d").take(here), b.column("t").take(here), pa.array(start[part]), pa.array(~on)], names=["h", "g", "d", "t", "start", "gone"])

    return run


def count_sketch(texts: DataFrame, size: int, cells: int) -> list[np.ndarray]:
    """The merged sketch of all anchors in ``texts`` (text): for each row the bits of cells that count two or more.

    Partitions send the cells they touched, two bytes each; blocks of cells are added up side
    by side, and bits alone reach the driver, cells / 8 bytes.
    """
    per_row = max(cells // DEPTH, BLOCK)
    dealt = texts.mapInArrow(_sketch(size, per_row), "row int, block int, cells binary").repartition("row", "block").sortWithinPartitions("row", "block")
    bits = [np.zeros(per_row // 8, np.uint8) for _ in range(DEPTH)]
    for row, block, b in dealt.mapInPandas(_merge, "row int, block int, bits binary").collect():
        bits[row][block * BLOCK // 8 : (block + 1) * BLOCK // 8] = np.frombuffer(b, np.uint8)
    return bits


def _cut(size: int):
    def run(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, at in zip(texts, starts):
            words = t.encode("utf-8", "surrogatepass").split()
            if at is None or not len(at):
                out.append((len(words), 0, b" ".join(words)))
                continue
            edge = np.zeros(len(words) + 1, np.int32)
            at = np.asarray(at)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            gone = np.cumsum(edge[:-1]) > 0
            out.append((len(words), int(gone.sum()), b" ".join(w for w, x in zip(words, gone) if not x)))
        return pd.DataFrame({"n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept": [x[2] for x in out]})

    return run


def repeated_windows(keyed: DataFrame, size: int, *, cells: int | None = None) -> DataFrame:
    """d, t, starts of the windows in ``keyed`` (d, t, text) that occur earlier; d orders documents, and t tells texts apart.

    The sketch has about eight cells for each anchor, within its bounds.  A full sketch lets
    more windows through to the second pass and loses none.  The second pass groups whole
    windows, each known by 96 bits of a BLAKE2b digest of its words under a salt drawn for the run, so that
    two unlike ones of 10^13 windows meet with chance 1e-3 at most and no text can be made to: the least document of each is
    found by partial sums, and the others by a join that Spark can split when one window is very frequent.
    """
    spark = keyed.sparkSession
    if cells is None:
        size_b = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = 1 << max(LEAST_CELLS.bit_length() - 1, min(MOST_CELLS.bit_length() - 1, int(8 * size_b / 6 * 2 / (size - min(ANCHOR, size) + 2)).bit_length()))
    bits = spark.sparkContext.broadcast(count_sketch(keyed.select("text"), size, cells))
    kind = keyed.schema["d"].dataType.simpleString()
    found = durable(keyed.mapInArrow(_repeated(size, max(cells // DEPTH, BLOCK), bits, os.urandom(16)), f"h long, g int, d {kind}, t long, start int, gone boolean"), "substring-windows")
    bits.unpersist()
    here = found.where("NOT gone").select("h", "g", "d", "t", "start")
    first = durable(here.groupBy("h", "g").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last").select("h", "g", "first"), "substring-firsts")
    later = here.join(first.hint("merge"), ["h", "g"]).where("d > first").select("d", "t", "start").unionByName(found.where("gone").select("d", "t", "start"))
    starts = durable(later.groupBy("d", "t").agg(F.collect_set("start").alias("starts")), "substring-starts")
    drop(found)
    drop(first)
    return starts


def dedup_substrings(docs: DataFrame, *, size: int = 20, cells: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space) of each row.

    A word goes if a window of ``size`` words that covers it starts earlier as well, in a row
    of smaller id or earlier in its own.

    Nulls: a null text has no words; null ids come before all others.  Texts shorter than a
    window stay whole.  Rows of one id are one document and don't remove each other's windows;
    repeated rows come out alike.  An empty table gives no rows.  Other columns aren't read.
    """
    text = text_of(text_col)
    numeric = isinstance(docs.schema[id_col].dataType, IntegralType)
    least = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if numeric else F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), least.alias("d"), F.xxhash64(text).alias("t"), text.alias("text"))
    cut = F.pandas_udf(_cut(size), "n_words long, n_removed long, kept string")
    starts = repeated_windows(keyed.select("d", "t", "text"), size, cells=cells)
    return keyed.join(starts.hint("merge"), ["d", "t"], "left").select("doc_id", cut("text", "starts").alias("c")).select("doc_id", "c.n_words", "c.n_removed", "c.kept")


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, array_to_string(list_slice(w, s, s + 19), ' ') AS x FROM d, unnest(range(1, greatest(len(w) - 18, 1))) t(s)),
r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS k FROM x),
g AS (SELECT DISTINCT doc_id, s + i AS place FROM r, unnest(range(20)) u(i) WHERE k > 1),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n FROM p ANTI JOIN g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
