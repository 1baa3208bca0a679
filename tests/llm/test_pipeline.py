"""The stages one by one and the pipeline whole, against brute force; SQL of the operators at the smallest size."""

import os
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontamination, mixing, ngram_join, quality, queries, secrets, substrings

from test_edge_cases import BASE, TEXTS, docs, labels  # noqa: F401  fixtures

SF = "/root/testdata/sf0.001"


def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def shingles(text, n=5):
    w = (text or "").encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, threshold=0.8):
    """The class of each (key, text) by comparing all pairs."""
    sets, root = {k: shingles(t) for k, t in rows}, {k: k for k, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: top(k) for k in keys}


def windows(text, size=10):
    w = decontaminable(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def decontaminable(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [x for x in "".join(c if c > "\x7f" or "a" <= c <= "z" or "0" <= c <= "9" else " " for c in low).split(" ") if x]


def holds(text, items):
    w = decontaminable(text)
    found = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in {len(x) for x in items}}
    return any(x in found[len(x)] for x in items)


def test_words_of_equal_polynomials_are_told_apart(spark):
    """Strings that share a polynomial hash modulo 2^64 at any point."""
    a, b = thue_morse(10)
    shared = " ".join(f"w{i}" for i in range(19))
    got = substrings.dedup_substrings(spark.createDataFrame([(1, f"{a} {shared}"), (2, f"{b} {shared}")], "doc_id long, text string")).collect()
    assert [r["n_removed"] for r in got] == [0, 0]
    linked = ngram_join.jaccard_join(spark.createDataFrame([(1, f"{a} b c d e"), (2, f"{b} b c d e")], "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in linked) == [(1, 1, 0), (2, 2, 0)]


def test_exact_shingles_are_words_not_hashes():
    texts = ["a b c d e f", "a b c d e g", "a b c", "a b c", "", "f e d c b a"]
    got = [set(x) for x in ngram_join.exact_shingles(texts, 5)]
    want = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_refined_components_lose_no_link(spark, monkeypatch):
    """A chain of weakly alike texts holds classes of near copies; small tiles force the cut."""
    rows, key = [], 0
    for c in range(12):
        words = [f"shared{i}" for i in range(40)] + [f"own{c}x{i}" for i in range(60)]
        for k in range(6):
            rows.append((key, " ".join(w if i != 45 + k else f"edit{c}x{k}" for i, w in enumerate(words))))
            key += 1
    want = classes(rows)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 5)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == want and all(r["n_links"] == 5 for r in got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_join_finds_all_links_of_documents(spark):
    """Recall over real rows: all pairs by brute force."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r["class_id"] for r in ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    told = con.execute(queries.ORACLES[name])
    at = [[c[0] for c in told.description].index(n) for n in names]
    assert sorted(tuple(map(str, r)) for r in df.select(*names).collect()) == sorted(tuple(str(r[i]) for i in at) for r in told.fetchall())


def _clashing(df):
    """``df`` with columns that the stages use inside."""
    for c in ("doc", "hit", "first", "node", "copies", "threshold", "whole", "p_source", "tile", "key", "score", "label"):
        df = df.withColumn(c, F.lit(c)) if c not in df.columns else df
    return df


def test_stages_handle_edges_and_clashing_columns(spark, docs, labels):  # noqa: F811
    given = _clashing(docs)
    items = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(10, 22))), (2, "two"), (3, None)], "item_id long, text string")
    for name, stage in (("good", lambda d: quality.keep_good(d, labels)), ("one", ngram_join.keep_one_each), ("clean", lambda d: decontamination.drop_contaminated(d, items)), ("masked", secrets.mask_secrets)):
        out = stage(given)
        assert out.columns == given.columns and out.schema == given.schema, name
        kept = out.collect()
        assert all(r["doc"] == "clash" and r["hit"] == "hit" and r["threshold"] == "threshold" for r in kept), name
        assert stage(given.limit(0)).count() == 0, name
    # the texts of 1 and 2 are alike, and so are those of null and 9, or all of them; the words of the others are their own
    want = classes([(i if i is not None else -1, t) for i, t in {(i, t) for i, t, *_ in TEXTS}])
    assert {r["doc_id"] if r["doc_id"] is not None else -1 for r in ngram_join.keep_one_each(given).collect()} == set(want.values())
    clean = sorted(str(r["doc_id"]) for r in decontamination.drop_contaminated(given, items).collect())
    assert clean == sorted(["3", "4", "6", "8"])
    assert {r["doc_id"] for r in secrets.mask_secrets(given).collect()} == {i for i, *_ in TEXTS}
    mix = mixing.take_mix(given)
    assert set(mix.columns) == set(given.columns) and all(r["copies"] > 0 and r["whole"] == "whole" for r in mix.collect())
    assert mixing.take_mix(given.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stage_by_stage(spark):
    """Each stage on what its predecessor kept, against brute force; the classifier against its own scores and the labels."""
    source = spark.read.parquet(f"{SF}/documents.parquet")
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = {w for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in windows(r["text"])}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    now, seen = source, {}
    for name, stage in corpus_pipeline.STAGES:
        before = texts(now)
        now = spark.createDataFrame(stage(spark, now, SF).toPandas(), schema=source.schema if name != corpus_pipeline.STAGES[-1][0] else None)
        seen[name] = (before, now)
    good, kept = seen["quality classifier"][0], texts(seen["quality classifier"][1])
    assert all(good[i] == t for i, t in kept.items())
    known = [i for i in good if i in marks]
    assert sum((i in kept) == (marks[i] == 1) for i in known) / len(known) > 0.85
    before, after = seen["n-gram Jaccard join"]
    first = {}
    for i, c in classes(sorted(before.items())).items():
        first.setdefault(c if shingles(before[i]) else ("empty", before[i], i), i)
    assert set(texts(after)) == set(first.values())
    before, after = seen["benchmark decontamination"]
    assert set(texts(after)) == {i for i, t in before.items() if not holds(t, items)}
    before, after = seen["secret scans"]
    masked, owners = texts(after), defaultdict(set)
    where = {r["doc_id"]: r["source"] for r in source.collect()}
    for i, t in before.items():
        for _, _, _, value in secrets.scan_text(t or ""):
            owners[value].add(where[i])
    for i, t in before.items():
        base = [(s, e, v) for k, s, e, v in secrets.scan_text(t or "") if k < 3 and len(owners[v]) < 3]
        assert (masked[i] != t) >= bool(base) and not any(t[s:e] in masked[i] for s, e, _ in base)
    before, after = seen["mixing sources to target weights"]
    rows = after.collect()
    sizes, taken = Counter(), Counter()
    for i, t in before.items():
        sizes[where[i]] += len((t or "").encode().split())
    for r in rows:
        assert 1 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * len((r["text"] or "").encode().split())
    targets = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(sorted(sizes.items()), "source string, size long")).collect()}
    longest = max(len((t or "").split()) for t in before.values())
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    whole = {(r["doc_id"], r["text"], r["copies"]) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r["doc_id"], r["text"], r["copies"]) for r in rows}
