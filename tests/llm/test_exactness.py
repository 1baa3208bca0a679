"""Exact counts and cuts: repeats in very long texts, hits among many harmless phrases, pseudo-labels by rank."""

import math
import time

import pandas as pd
from pyspark.sql import functions as F

from lodestone.llm import quality, rules, toxicity
from lodestone.llm.common import words_of


def test_repeats_of_more_than_a_million_words(spark):
    """Isolated phrases of three words, each twice, between words that occur once."""
    text = "concat_ws(' ', transform(sequence(0, 299999), i -> concat_ws(' ', 'a' || (i % 150000), 'b' || (i % 150000), 'c' || (i % 150000), 'only' || i)))"
    df = spark.range(1).selectExpr(f"{text} AS t").select(words_of(F.col("t")).alias("w"))
    got = df.select(F.size("w").alias("n"), rules.repeat_words(F.col("w")).alias("r")).first()
    assert (got.n, got.r) == (1_200_000, 900_000)


def test_hits_take_time_in_proportion(spark):
    lexicon = toxicity.Lexicon({" badword ": 2.0, " awf": 1.0}, (" no badword ", " badword here ", " a badword b "))
    a = lexicon.automaton()
    pieces = ["no badword", "badword here", "a badword b", "badword", "awful", "fine words", "awful no badword here"]
    brute = lambda folded: [(s, e, w) for s, e, w in _all(folded, lexicon) if not any(x <= s < y for p in lexicon.phrases for x, y in _places(folded, p))]
    for k in range(200):
        folded = toxicity.fold(" ".join(pieces[(k * 7 + i * i) % len(pieces)] for i in range(k % 23)))
        assert toxicity.hits(folded, a) == brute(folded), folded
    long = toxicity.fold(" ".join(pieces) + " ").strip() + " "
    start = time.time()
    assert len(toxicity.hits(" " + long * 40_000, a)) == 40_000 * len(toxicity.hits(" " + long, a))  # 3 MB
    assert time.time() - start < 60
    assert toxicity._measures("", a) == (0, 0, 0) and toxicity._measures("badword", a)[2] == 1


def _places(text, piece):
    at = text.find(piece)
    while at >= 0:
        yield at, at + len(piece) - 1  # the last character, as the blank after a piece may begin the next
        at = text.find(piece, at + 1)


def _all(text, lexicon):
    found = {}
    for entry, w in lexicon.weights.items():
        for s, e in _places(text, entry):
            if s not in found or found[s][1] < w:
                found[s] = (e, w)
    return [(s, e, w) for s, (e, w) in sorted(found.items())]


def test_pseudo_labels_are_the_surest_by_rank(spark):
    """Against a sort of all rows, with many equal chances, rows already lent and rows of an even chance."""
    weights = {"a": 6.0, "b": 5.0, "c": 0.1, "d": -5.0, "e": -6.0, "f": -0.1}
    rows = spark.range(20000).selectExpr("id AS doc_id", "element_at(array('a', 'b', 'c', 'd', 'e', 'f'), int(pmod(xxhash64(id, 3), 6)) + 1) AS source")
    view = quality.View({}, {}, {"source": weights})
    place = {r.doc_id: r.p for r in rows.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("p")).collect()}
    chance = {s: 1 / (1 + math.exp(-w)) for s, w in weights.items()}
    lent, all_rows = rows.limit(0).toPandas(), rows.collect()
    for _ in range(4):
        got = quality.surest(rows, view, lent, 0.7, 3000)
        want = []
        for mark, k in ((1, 2100), (0, 900)):
            sure = [(round(max(chance[r.source], 1 - chance[r.source]), 6), place[r.doc_id], -r.doc_id) for r in all_rows if (chance[r.source] > 0.5) == bool(mark) and r.doc_id not in set(lent["doc_id"])]
            want += [-d for c, _, d in sorted((x for x in sure if x[0] >= 0.9), reverse=True)[:k]]
        assert sorted(got["doc_id"]) == sorted(want)
        lent = pd.concat([x for x in (lent, got) if len(x)])


def test_a_view_that_tells_nothing_lends_nothing(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "'x' AS source")
    view = quality.View({}, {}, {"source": {"x": 1.7}})  # a chance of 0.85, the share of good ones
    assert len(quality.surest(rows, view, rows.limit(0).toPandas(), 0.85, 100)) == 0


def test_groups_are_fitted_as_if_they_were_columns():
    import numpy as np

    draw = np.random.default_rng(1)
    x, group, y = draw.normal(size=(5000, 3)), draw.integers(-1, 6, 5000), draw.integers(0, 2, 5000).astype(float)
    x[:, 0] = 1
    b, s = quality._logistic(x, y, 1.0, group)
    wide = np.concatenate([x, (group[:, None] == np.arange(6)[None, :]).astype(float)], axis=1)
    b2, _ = quality._logistic(wide, y, 1.0)
    assert np.allclose(np.concatenate([b, s]), b2, atol=1e-3)
