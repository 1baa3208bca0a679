"""Indexed lexical search: posting lists of grams, met from the rarest, then the exact test."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import held
from .search import lexical

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors may not have this package

#: Characters of a gram, and how many of a needle's rarest grams are met before its lines are read.
GRAM, RAREST = 3, 3
#: Files of a block, about; a posting tells by bits in which of its SLOTS a gram is, so that a gram has a row a block and not a row a file.
BLOCK_FILES, SLOTS = 64, 64
#: Blocks that one task reads when it builds the index or meets its lines.
BLOCKS_A_TASK = 256
#: Characters of which the grams are taken at once; as many kinds of them at most, so a gram and a slot fit into 63 bits.
CHUNK = 400_000
#: Postings that one task sorts.
POSTINGS_A_TASK = 2_000_000
#: Needles' grams up to this number are broadcast; more of them are shuffled.
FEW_GRAMS = 200_000
#: Candidates up to this number are broadcast to the lines; more of them meet the lines by block.
FEW_CANDIDATES = 200_000
#: Alternatives of a pattern that are told apart; a pattern of more is looked for in all files.
ALTERNATIVES = 16
#: Folding of letters for grams: ASCII, and the two letters beside them whose small form is or holds an ASCII one.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZKİ", "abcdefghijklmnopqrstuvwxyzki"
ASCII = r"^[\x00-\x7F]*$"

POSTINGS = "gram string, block long, slots long"


def _all_grams(folded: Column, n: int) -> Column:
    return F.regexp_extract_all(folded, F.lit(f"(?=([^\\n]{{{n}}}))"), F.lit(1))


def _joined(grams: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams once each, with the slots of all their rows."""
    first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    return grams[first], np.bitwise_or.reduceat(slots, first)


def _slots_of_grams(texts: list[str], slots: list[int]) -> tuple[list[str], np.ndarray]:
    """The grams of 1 to 3 characters within lines of texts, folded, and the bits of the slots whose texts have them."""
    fold = np.arange(0x110000, dtype="<u4")
    fold[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]
    chars = fold[np.frombuffer("".join([t + "\n\n" for t in texts]).encode("utf-32-le", "surrogatepass"), "<u4")]
    seen = np.zeros(0x110000, bool)
    seen[chars] = True
    kinds = np.flatnonzero(seen)
    rank = np.zeros(0x110000, "<i8")
    rank[kinds] = np.arange(len(kinds))
    n, r, at = len(kinds), rank[chars], np.repeat(np.array(slots, "<i8"), [len(t) + 2 for t in texts])
    each = np.sort((((r[:-2] * n + r[1:-1]) * n + r[2:]) * SLOTS) + at[:-2])
    gram, bits = _joined(each // SLOTS, np.left_shift(np.uint64(1), (each % SLOTS).astype("<u8")))
    found, masks = [], []
    for k in range(GRAM, 0, -1):
        places = np.stack([gram // n**i % n for i in range(k - 1, -1, -1)], 1)
        inside = (places != rank[10]).all(1)
        text = kinds[places[inside]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        found += [text[i : i + k] for i in range(0, len(text), k)]
        masks.append(bits[inside])
        gram, bits = _joined(gram // n, bits)
    return found, np.concatenate(masks).view("<i8")


def _block_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (block, slot, content) in order of their block; a gram of a large block may have several rows."""
    now, texts, slots, size = None, [], [], 0

    def rows() -> pa.RecordBatch:
        grams, bits = _slots_of_grams(texts, slots)
        every = np.bitwise_or.reduce(np.left_shift(np.uint64(1), np.array(slots, "<u8")), keepdims=True).view("<i8")
        return pa.record_batch({"gram": pa.array(["", *grams], pa.string()), "block": pa.array(np.full(len(grams) + 1, now, "<i8")), "slots": pa.array(np.concatenate([every, bits]))})

    for batch in batches:
        for block, slot, content in zip(batch["block"].to_pylist(), batch["slot"].to_pylist(), batch["content"].to_pylist()):
            content = content or ""
            for i in range(0, max(len(content), 1), CHUNK - GRAM):  # pieces of a long text share what a gram may span
                piece = content[i : i + CHUNK - 1]
                if texts and (block != now or size + len(piece) > CHUNK):
                    yield rows()
                    texts, slots, size = [], [], 0
                now, size = block, size + len(piece)
                texts.append(piece)
                slots.append(slot)
    if texts:
        yield rows()


def _file(root: str = "root_id", path: str = "path") -> Column:
    """A number for a file; files of one block and slot are candidates together, and the exact test tells them apart."""
    return F.xxhash64(root, path)


def located(files: DataFrame, blocks: int) -> DataFrame:
    """``files`` (root_id, path) or their lines with the block and the slot of each."""
    return files.select("*", F.pmod(_file(), F.lit(blocks)).alias("block"), F.shiftrightunsigned(_file(), 58).cast("int").alias("slot"))


def _tasks(spark: SparkSession, blocks: int) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-blocks // BLOCKS_A_TASK))


def postings(files: DataFrame) -> DataFrame:
    """(gram, block, slots, blocks) of files (root_id, path, content): in which slots of a block files have a gram, by bits, and the number of blocks.

    Each of the distinct grams of 1 to 3 characters within lines of a block has a row, or a few in a large block, so that the list of a common gram
    spreads over tasks; the empty gram stands for all files.
    """
    blocks = max(1, -(-files.count() // BLOCK_FILES))
    dealt = located(files, blocks).select("block", "slot", "content").repartition(_tasks(files.sparkSession, blocks), "block").sortWithinPartitions("block")
    return dealt.mapInArrow(_block_postings, POSTINGS).select("*", F.lit(blocks).cast("long").alias("blocks"))


def needed_grams(needle: Column, ignore_case: bool) -> Column:
    """Grams that each line with ``needle`` has; the empty one if nothing can be said."""
    folded = F.translate(needle, UPPER, LOWER)
    n = F.char_length(folded)
    found = F.when(n >= GRAM, _all_grams(folded, GRAM)).when(n > 0, F.array(folded)).otherwise(F.array().cast("array<string>"))
    if ignore_case:  # other letters than ASCII aren't folded in the index
        found = F.filter(found, lambda g: g.rlike(ASCII))
    found = F.array_distinct(F.filter(found, lambda g: ~g.contains("\n")))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def candidate_files(index: DataFrame, needles: DataFrame, ignore_case: bool = False) -> DataFrame:
    """(needle, block, slots) of distinct needles (needle): where files have the rarest grams of a needle, by postings."""
    asked = held(needles.select("needle").distinct().select("needle", F.explode(needed_grams(F.col("needle"), ignore_case)).alias("gram")), "asked-grams")
    grams = asked.select("gram").distinct()
    few = grams.limit(FEW_GRAMS + 1).count() <= FEW_GRAMS
    met = held(index.join(F.broadcast(grams) if few else grams, "gram").select("gram", "block", "slots"), "met-postings")
    known = asked.join(met.groupBy("gram").agg(F.sum(F.bit_count("slots")).alias("n")), "gram", "left").select("needle", "gram", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy("needle")
    chosen = known.select("needle", "gram", F.row_number().over(w.orderBy("n", "gram")).alias("rank"), F.least(F.count("*").over(w), F.lit(RAREST)).alias("of")).where(F.col("rank") <= RAREST)
    bits = [F.bit_or(F.when(F.col("rank") == k, F.col("slots"))) for k in range(1, RAREST + 1)]
    of_each = chosen.join(met, "gram").groupBy("needle", "block").agg(F.max("of").alias("of"), *[b.alias(f"b{k}") for k, b in enumerate(bits)])
    shared = F.lit(-1).cast("long")
    for k in range(RAREST):
        shared = shared.bitwiseAND(F.when(F.col("of") > k, F.coalesce(f"b{k}", F.lit(0).cast("long"))).otherwise(F.lit(-1).cast("long")))
    return of_each.select("needle", "block", shared.alias("slots")).where("slots != 0")


def in_slots(lines: DataFrame, candidates: DataFrame) -> DataFrame:
    """``lines`` (block, slot and more) joined to the candidates (block, slots and more) that name their slot."""
    if candidates.limit(FEW_CANDIDATES + 1).count() <= FEW_CANDIDATES:
        both = lines.join(F.broadcast(candidates), "block")
    else:
        n = _tasks(lines.sparkSession, candidates.agg(F.max("block")).first()[0] + 1)
        both = lines.repartition(n, "block").join(candidates.repartition(n, "block").hint("shuffle_hash"), "block")
    return both.where(F.getbit("slots", F.col("slot")) == 1)


def verified(lines: DataFrame, candidates: DataFrame, ignore_case: bool = False) -> DataFrame:
    """needle, root_id, path, line_number, line of the lines (``located``) of candidates (needle, block, slots; held) that hold the needle."""
    low = F.lower if ignore_case else F.col
    met = in_slots(lines.select("root_id", "path", "line_number", "line", low("line").alias("low"), "block", "slot"), candidates.select(low("needle").alias("sought"), "*"))
    return met.where(F.col("low").contains(F.col("sought"))).select("needle", "root_id", "path", "line_number", "line")


def lines_of(lines: DataFrame, index: DataFrame) -> DataFrame:
    """``lines`` with the blocks and slots of an index: those of a kept one have them."""
    if "block" in lines.columns:
        return lines
    some = index.select("blocks").first()
    return located(lines, some.blocks if some else 1)


def search_many(lines: DataFrame, index: DataFrame, needles: DataFrame, *, ignore_case: bool = False) -> DataFrame:
    """needle, root_id, path, line_number, line of all lines that hold a needle, for all needles in one pass.

    Null and empty needles find nothing; a needle of one or two characters has a gram of its own.
    """
    return verified(lines_of(lines, index), held(candidate_files(index, needles.where("needle != ''"), ignore_case), "candidates"), ignore_case)


# ---- a kept index


def save_postings(files: DataFrame, lines: DataFrame, where: str) -> None:
    """Write the index of files (root_id, path, content) and their lines: posting lists in order of gram, so that a read of few grams skips the rest, in how
    many slots each gram is, and the lines in order of their block."""
    spark = files.sparkSession
    found = held(postings(files), "postings")
    n = max(spark.sparkContext.defaultParallelism, -(-found.count() // POSTINGS_A_TASK))
    found.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{where}/postings")
    spark.read.parquet(f"{where}/postings").groupBy("gram").agg(F.sum(F.bit_count("slots")).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{where}/grams")
    some = found.select("blocks").first()
    blocks = some.blocks if some else 1
    located(lines, blocks).repartition(_tasks(spark, blocks), "block").sortWithinPartitions("block").write.mode("overwrite").parquet(f"{where}/lines")


def _literals(tree) -> list[frozenset[str]]:
    """Alternatives of literals that each match of a parsed pattern holds; one empty alternative says nothing."""
    found, run = [frozenset()], ""

    def also(more: list[frozenset[str]]) -> None:
        nonlocal found
        both = {a | b for a in found for b in more}
        found = list(both) if len(both) <= ALTERNATIVES else found

    for op, value in [*tree, (None, None)]:
        if op is C.LITERAL:
            run += chr(value)
            continue
        if run:
            also([frozenset([run])])
            run = ""
        if op is C.SUBPATTERN:
            also(_literals(value[3]))
        elif op is C.BRANCH:
            ways = {w for branch in value[1] for w in _literals(branch)}
            also(list(ways) if len(ways) <= ALTERNATIVES else [frozenset()])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] > 0:
            also(_literals(value[2]))
    return found


def required(pattern: str, ignore_case: bool = False) -> list[frozenset[str]]:
    """Alternatives of grams one of which each line that matches a regex must have whole; an empty one says nothing."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return [frozenset()]
    if "\\0" in pattern:  # octal numbers are read in another way
        return [frozenset()]
    loose = ignore_case or bool(parsed.state.flags & re.IGNORECASE) or "(?" in pattern.replace("(?:", "").replace("(?P<", "").replace("(?<", "")
    fold = str.maketrans(UPPER, LOWER)
    ways = []
    for way in _literals(parsed):
        texts = [x.translate(fold) for x in way if "\n" not in x]
        grams = {x[i : i + GRAM] for x in texts for i in range(max(1, len(x) - GRAM + 1)) if x}
        ways.append(frozenset(g for g in grams if not loose or g.isascii()))
    return [frozenset()] if frozenset() in ways else ways


def search_index(spark: SparkSession, where: str, pattern: str, *, literal: bool = False, ignore_case: bool = False, **options) -> DataFrame:
    """The rows of ``lexical``, by an index of ``save_postings``: only files that have the rarest grams that a match needs are read.

    A folder without an index is an error.  A pattern that needs no gram is looked for in all lines.
    """
    built = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/lines/_SUCCESS")  # the last part written
    if not built.getFileSystem(spark._jsc.hadoopConfiguration()).exists(built):
        raise FileNotFoundError(f"there is no lexical index at {where}: write one with save_postings")
    lines = spark.read.parquet(f"{where}/lines")
    ways = required(re.escape(pattern) if literal else pattern, ignore_case)
    if frozenset() not in ways:
        asked = sorted({g for way in ways for g in way})
        counts = {r.gram: r.n for r in spark.read.parquet(f"{where}/grams").where(F.col("gram").isin(asked)).collect()}  # at most a row for each gram of the pattern
        rare = [sorted(way, key=lambda g: (counts.get(g, 0), g))[:RAREST] for way in ways if all(g in counts for g in way)]
        met = spark.read.parquet(f"{where}/postings").where(F.col("gram").isin(sorted({g for way in rare for g in way})))
        shared = F.lit(0).cast("long")
        for way in rare:
            bits = F.lit(-1).cast("long")
            for g in way:
                bits = bits.bitwiseAND(F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("slots"))), F.lit(0).cast("long")))
            shared = shared.bitwiseOR(bits)
        lines = in_slots(lines, met.groupBy("block").agg(shared.alias("slots")).where("slots != 0"))
    return lexical(lines, pattern, literal=literal, ignore_case=ignore_case, **options)
