"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, read, text_of

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ℓ": "l",
}
#: Digits and signs that stand for letters; signs count only between letters.
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
#: "1" stands for i and for l, so these two are one letter in folded text.
MERGED = {"l": "i"}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "pond scum", "soap scum", "sore loser")

_SIGN = re.compile(r"(?<=\w)[@$!|](?=\w)")


class _Fold(dict):
    def __missing__(self, code: int) -> str | None:
        out = []
        for c in unicodedata.normalize("NFKC", chr(code)).lower():
            c = DIGITS.get(c, HOMOGLYPHS.get(c, c))
            kind = unicodedata.category(c)
            if c.isalpha():
                out.append(MERGED.get(c, c))
            elif kind not in ("Mn", "Cf"):
                out.append(" ")
        self[code] = found = "".join(out)
        return found


_FOLD = _Fold()


def fold(text: str) -> str:
    """Words of look-alikes as their plain letters, between single spaces, with a space at either end."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    if any(s in text for s in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return " " + " ".join(text.translate(_FOLD).split()) + " "


@dataclass
class Lexicon:
    """Weighted entries " word " or " prefix", harmless phrases " a b ", and the curve from sums to a score."""

    weights: dict[str, float]
    phrases: tuple[str, ...] = ()
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        a = ahocorasick.Automaton()
        for p in self.phrases:
            a.add_word(p, (len(p), None))
        for entry, w in self.weights.items():
            a.add_word(entry, (len(entry), w))
        if len(a):
            a.make_automaton()
        return a


def hits(folded: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the entries found outside harmless phrases; one for a word, the heaviest."""
    if not len(automaton):
        return []
    found, harmless = {}, []
    for end, (n, w) in automaton.iter(folded):
        start = end - n + 1
        if w is None:
            harmless.append((start, end))
        elif start not in found or found[start][1] < w:
            found[start] = (end, w)
    harmless.sort()
    kept, k, upto = [], 0, 0
    for s, (e, w) in sorted(found.items()):
        while k < len(harmless) and harmless[k][0] <= s:
            upto, k = max(upto, harmless[k][1]), k + 1
        if s >= upto:
            kept.append((s, e, w))
    return kept


def _measures(text: str, automaton: ahocorasick.Automaton) -> tuple[int, float, int]:
    f = fold(text)
    found = hits(f, automaton)
    return len(found), sum(w for _, _, w in found), len(f.split())


def _curve(total: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(total)), np.log1p(100 * total / (n_words + 20)), np.log1p(total)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    b = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (weight * (y - p)) - keep @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return b


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(text=[fold(t).strip() for t in b["text"]])


def learn_lexicon(rows: DataFrame, *, max_rows: int = 6000, min_contexts: int = 8, min_ratio: float = 10.0, prefix_lengths: tuple[int, ...] = (4, 5, 6)) -> Lexicon:
    """A lexicon from labelled rows (text, toxic, size of its class as class_n).

    ``max_rows`` bounds each class; those of smallest hash are taken by the caller.  A word's
    evidence is the number of different neighbourhoods in which it stands in rows of either
    class, so that copies of one text count once.  A prefix stands for its words if several of
    them point the same way.  All entries and phrases with the asked evidence are taken; the sample bounds
    their number, as each needs ``min_contexts`` neighbourhoods or three places in it.
    """
    given = durable(rows.dropDuplicates(["text", "toxic"]).mapInPandas(_folded, "text string, toxic int, class_n long"), "toxic-sample")
    w = F.split("text", " ")
    near = given.select("toxic", w.alias("w")).select("toxic", F.explode(F.arrays_zip(F.col("w").alias("word"), F.concat(F.array(F.lit("")), "w").alias("before"), F.slice("w", 2, 1 << 30).alias("after"))).alias("x"))
    near = near.where("x.word != ''").select(F.col("x.word").alias("word"), F.xxhash64("x.before", "x.after").alias("near"), "toxic").distinct()
    counts = near.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    totals = near.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    all_t, all_c = totals["t"] or 0, (totals["n"] or 0) - (totals["t"] or 0)
    if not all_t or not all_c:
        return Lexicon({}, (), (-5.0, 0.0, 0.0))
    ratio = F.log((F.col("t") + 0.5) / (all_t + 1) / ((F.col("c") + 0.5) / (all_c + 1)))
    strong = (F.col("t") >= min_contexts) & (ratio >= math.log(min_ratio))
    stems = counts.select("*", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in prefix_lengths])).alias("stem")).where("stem IS NOT NULL")
    stems = stems.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if((F.col("t") >= 3) & (F.col("t") * all_c > min_ratio * (F.col("c") + 0.5) * all_t)).alias("words"))
    pick = lambda df, name: [(r[name], r["w"]) for r in df.where(strong).select(name, ratio.alias("w"), "t").collect()]
    weights: dict[str, float] = {}
    for stem, x in sorted(pick(stems.where("words >= 3"), "stem"), key=lambda s: (len(s[0]), s[0])):
        if not any(" " + stem[:n] in weights for n in prefix_lengths):
            weights[" " + stem] = round(x, 4)
    for word, x in pick(counts, "word"):
        if not any(" " + word[:n] in weights for n in prefix_lengths):
            weights[f" {word} "] = round(x, 4)
    lexicon = Lexicon(weights, tuple(fold(p) for p in EXCEPTIONS))

    def phrases(batches):
        a = lexicon.automaton()
        for b in batches:
            out = []
            for t, y in zip(b["text"], b["toxic"]):
                f = f" {t} "
                for s, e, _ in hits(f, a):
                    stop = e if f[e] == " " else f.index(" ", e)
                    end = f.find(" ", stop + 1)
                    before = f.rfind(" ", 0, s)
                    out += [(f[s : end + 1], y)] * (end > 0) + [(f[before : stop + 1], y)] * (before >= 0)
            yield pd.DataFrame(out, columns=["phrase", "toxic"]).astype({"toxic": "int32"})

    seen = given.mapInPandas(phrases, "phrase string, toxic int").groupBy("phrase").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    lexicon.phrases += tuple(r[0] for r in seen.where("t = 0 AND n >= 3").select("phrase").orderBy("phrase").collect())

    def measure(batches):
        a = lexicon.automaton()
        for b in batches:
            got = [_measures(t, a) for t in b["text"]]
            yield pd.DataFrame({"total": [x[1] for x in got], "n": [x[2] for x in got], "toxic": b["toxic"], "class_n": b["class_n"]})

    # two numbers a row of the bounded sample
    m = given.select("text", "toxic", "class_n").mapInPandas(measure, "total double, n long, toxic int, class_n long").toPandas().sort_values(["total", "n", "toxic"])
    y = m["toxic"].to_numpy(float)
    share = m["class_n"].to_numpy(float) / np.where(y == 1, y.sum(), len(y) - y.sum())
    lexicon.curve = tuple(float(v) for v in _fit(_curve(m["total"].to_numpy(), m["n"].to_numpy()), y, share / share.mean()))
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = 6000) -> DataFrame:
    """text, toxic, class_n of at most ``max_rows`` labelled documents of each class, those of smallest id hash.

    Documents whose crc32 of the id is a multiple of 5 are left out.  The two bounded lists of
    ids are broadcast: 2 x ``max_rows`` rows of three numbers.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    part = lambda y: known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("class_n", F.lit(sizes.get(y, 0)).cast("long"))
    return docs.join(F.broadcast(part(0).unionByName(part(1))), "doc_id").select("text", "toxic", "class_n")


def score_toxicity(docs: DataFrame, lexicon: Lexicon, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits of each row.

    The sum of weights found, alone and for its length, goes through the lexicon's curve.
    Nulls: a null text is empty; an empty one scores as a text without hits; a null id isn't
    held out.  Repeated rows score alike.  An empty table gives no rows.  Other columns aren't
    read.
    """
    curve = np.array(lexicon.curve)

    def run(batches):
        a = lexicon.automaton()
        for b in batches:
            got = [_measures(t, a) for t in b.pop("text")]
            z = _curve(np.array([x[1] for x in got], float), np.array([x[2] for x in got], float)) @ curve if got else np.zeros(0)
            yield b.assign(score=1 / (1 + np.exp(-np.clip(z, -30, 30))), n_hits=[x[0] for x in got])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
    scored = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), text_of(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, n_hits long")
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_hits")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    own = docs.select("doc_id", text_of("text").alias("text"))
    return score_toxicity(docs, learn_lexicon(training_rows(own, read(spark, sf_dir, "labels"))))
