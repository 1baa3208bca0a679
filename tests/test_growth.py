"""Steps that grow no faster than their input: what is dealt out between tasks, and how large one task becomes."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestone.operators import cards, context, similarity
from lodestone.plans import catalog
from lodestone.sources import scratch
from lodestone.streaming import keyed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_that_fall_short_are_not_dealt_out(spark):
    sets = lambda side: spark.range(300).select(F.concat(F.lit(side), "id").alias("file"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id"), F.col("id") + (1000 if side == "a" else 2000))).alias("element"))
    df = similarity.similar_pairs(sets("a"), sets("b"), 0.25)
    assert "hashpartitioning(old" not in _plan(df)  # all 90,000 pairs share an element
    assert sorted((r.old, r.new, r.similarity) for r in df.collect()) == sorted((f"a{i}", f"b{i}", 0.5) for i in range(300))


def test_references_meet_counts_of_symbols(spark):
    symbols = spark.createDataFrame([(f"s{i:03}", "f", f"m{i}::f", f"{i}.rs", "public" if i % 2 else "private", "r") for i in range(200)] + [("t", "g", "g", "a.rs", "crate", "r"), ("u", "g", "g2", "b.rs", "private", "r"), ("v", "g", "g3", "c.rs", None, "r")], "id string, name string, qualified_name string, file string, visibility string, root_id string")
    refs = [(f"o{i}", "f", f"{i}.rs", "r") for i in range(5)] + [("far", "f", "z.rs", "r"), ("one", "m7::f", "z.rs", "r"), ("near", "f", "y.rs", "r"), ("hidden", "f", "x.rs", "r"), ("g", "g", "z.rs", "r"), ("root", "g", "z.rs", "q")]
    known = spark.createDataFrame([("y.rs", "4.rs"), ("y.rs", "5.rs"), ("x.rs", "4.rs")], "file string, target_file string")
    df = cards.resolve_references(spark.createDataFrame(refs, "ref string, target string, file string, root_id string"), symbols, known)
    assert "collect_list" not in _plan(df)  # of all symbols of a name, for each reference
    assert sorted(map(tuple, df.collect())) == [("g", "t"), ("near", "s005"), *[(f"o{i}", f"s{i:03}") for i in range(5)], ("one", "s007")]


def test_shared_evidence_is_ranked_once(spark):
    asks = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x")], "ask string, topic int, text string")
    evidence = spark.createDataFrame([(1, f"i{k:02}", k % 3) for k in range(30)], "topic int, item string, score int")
    got = {r.ask: (r.n_evidence, r.evidence) for r in context.ask_packets(asks, evidence, 4, by="topic").collect()}
    assert got == {"a": (4, ["i02", "i05", "i08", "i11"]), "b": (4, ["i02", "i05", "i08", "i11"]), "c": (0, [])}


def test_renames_of_many_parts(spark, tmp_path):
    spark.createDataFrame([(0,), (1,), (100_000,), (100_001,), (200_003,), (3,)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(map(str, map(tuple, catalog.QUERIES["changed_with_renames"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, [(0, "renamed", 100_000), (1, "modified", None), (100_000, "renamed", 200_000), (100_001, "modified", None), (400_003, "added", None), (200_003 - 200_000 + 200_000, "added", None)]))


def test_means_add_in_the_order_of_the_table(spark, tmp_path):
    from itertools import product

    kinds = [x for x in product((0.0, 0.02, 0.03, 0.05, 0.06, 0.08, 0.09, 0.11), repeat=4) if all(y * 100 % 3 != 1 for y in x)]
    spark.createDataFrame([(j, i, x[j]) for j in range(4) for i, x in enumerate(kinds)], "at int, l_orderkey int, l_discount double").repartitionByRange(4, "at").sortWithinPartitions("at", "l_orderkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task a file
    got = {r.link: r.tier for r in catalog.QUERIES["demoted_tiers"](spark, str(tmp_path)).collect()}
    spark.conf.unset("spark.sql.files.openCostInBytes")
    mean = lambda x: (((x[0] * 10 + x[1] * 10) + x[2] * 10) + x[3] * 10) / 4
    tier = lambda x: "below_threshold" if mean(x) < 0.6 else "review_queue" if mean(x) < 0.85 or min(y * 10 for y in x) < 0.9 else "high"
    assert got == {i: tier(x) for i, x in enumerate(kinds)}


def test_suppression_within_a_second(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [(1, 7, at(10.2), "view"), (2, 7, at(10.5), "error"), (3, 7, at(10.7), "view"), (4, 7, at(3610.4), "view"), (5, 7, at(3610.6), "view")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.id for r in catalog.QUERIES["suppression_ttl"](spark, str(tmp_path)).collect()} == {1, 5}


def test_shingles_of_long_texts(spark):
    from hashlib import md5

    from lodestone.functions import sets

    texts = ["é\n" * 70_000 + "end", "a😀b\n" * 2000, "x" * 31, "", None, "".join(chr(97 + i * i % 23) for i in range(9000))]
    md5s = lambda w: {md5(w[i : i + 32].encode()).hexdigest() for i in range(0, len(w) - 31, 32)}
    want = lambda x: sorted(md5s(x[:4096]) | md5s(x[len(x) // 2 - 2048 : len(x) // 2 + 2048] if len(x) > 4096 else "") | md5s(x[-4096:])) if x else [] if x == "" else None
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", sets.sampled_shingles(F.col("t")).alias("s")).collect()}
    assert {i: got[i] or [] for i in got} == {i: (want(x) or []) for i, x in enumerate(texts)}


def test_pairs_of_tests_come_from_many_tasks(spark):
    files = spark.createDataFrame([(f"a/s{i}.py",) for i in range(60)] + [(f"a/tests/t{i}.py",) for i in range(60)] + [("a/tests/s1_test.py",), ("b/s1.py",), ("b/s1.py",)], "path string")
    df = cards.test_pairs(files)
    rows = [tuple(r) for r in df.collect()]
    own = {(f"a/s{i}.py", t) for i in range(60) for t in [f"a/tests/t{k}.py" for k in range(60)] + ["a/tests/s1_test.py"]}
    assert len(rows) == len(set(rows)) and set(rows) == own | {("b/s1.py", "a/tests/s1_test.py")}
    assert "hashpartitioning(source" not in _plan(df)  # no pairs are dealt out


def test_hot_keys_are_dealt_into_parts(spark):
    left, right = spark.createDataFrame([("k", i) for i in range(50)] + [("l", 0), ("n", 0)], "key string, a int"), spark.createDataFrame([("k", i) for i in range(70)] + [("l", 1), ("m", 2)], "key string, b int")
    df = scratch.hot_join(left, right, "key", 10)
    assert sorted(map(tuple, df.select("key", "a", "b").collect())) == sorted(map(tuple, left.join(right, "key").select("key", "a", "b").collect()))
    sizes = sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert len(sizes) > 1 and sizes[-1] < 3501  # in several tasks


def test_a_quote_is_compared_once(spark, monkeypatch, tmp_path):
    rows = [(i, "the quick brown fox", "the quick brown cat") for i in range(500)] + [(500, None, "x"), (501, "abc", None)]
    df = similarity.verify_spans(spark.createDataFrame(rows, "id int, quoted string, source string"), 0.8)
    assert "HashAggregate" in _plan(df)  # of equal quotes and sources
    got = {r.id: (r.stage, round(r.ratio, 3)) for r in df.collect()}
    assert len(got) == 502 and {got[i] for i in range(500)} == {("near", 0.842)} and got[500] == got[501] == ("missing", 0.0)


def test_a_replay_deals_many_rows_into_more_batches(spark, tmp_path):
    rows = spark.range(100).select(F.lit("r").alias("root"), F.concat(F.lit("p"), F.col("id") % 9).alias("path"), F.timestamp_seconds(F.col("id") * 60 + F.floor(F.col("id") / 20) * 900 + 86400).alias("ts"))
    got = keyed.replayed(rows, lambda s: keyed.debounced(s, timedelta(minutes=5), 3), keyed.BURSTS, f"file://{tmp_path}/r", 1, most=30)
    assert sorted(map(str, got.collect())) == sorted(map(str, keyed.debounced(rows, timedelta(minutes=5), 3).collect()))
    assert len(list(tmp_path.glob("r/in/part=*"))) == 5  # four of them, and the end


def test_a_gram_has_a_row_a_block(spark, monkeypatch):
    from lodestone.operators import postings
    from lodestone.operators.search import lexical

    monkeypatch.setattr(postings, "CHUNK", 50)
    monkeypatch.setattr(postings, "FEW_CANDIDATES", 3)
    texts = ["the same words\nin many files", "Kelvin K İ\x00\x00é😀", "", None, "x" * 49 + "yz" + "w" * 47 + "ab\nc"]
    files = spark.createDataFrame([("r", f"{i}.rs", texts[0] if i < 600 else texts[i % 5]) for i in range(640)], "root_id string, path string, content string").repartition(3)
    index = postings.postings(files)
    got = index.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("block").alias("blocks")).collect()
    folded = lambda t: "".join({"K": "k", "İ": "i"}.get(c, c.lower() if c.isascii() else c) for c in t)
    want = {line[i : i + n] for t in texts if t for line in folded(t).split("\n") for n in (1, 2, 3) for i in range(len(line) - n + 1)}
    assert {r.gram for r in got} == want | {""}
    assert max(r.blocks for r in got) <= 10  # of 640 files
    lines = files.select("root_id", "path", F.posexplode(F.split("content", "\n")).alias("line_number", "line"))
    for n in ("many", "xyz", "wab", "\x00\x00é", "😀", "q"):
        found = postings.search_many(lines, index, spark.createDataFrame([(n,)], "needle string")).count()
        assert found == lexical(lines, n, literal=True).count(), n


def test_pairs_of_commits_come_to_more_tasks(spark, monkeypatch):
    from lodestone.operators import history

    monkeypatch.setattr(history, "PAIRS_A_TASK", 10)
    changes = spark.createDataFrame([(r, f"p{(r * k) % 17:02}") for r in range(40) for k in range(1, 6)] * 2, "revision long, path string")
    commits = [sorted({f"p{(r * k) % 17:02}" for k in range(1, 6)}) for r in range(40)]
    want = {}
    for c in commits:
        for i, x in enumerate(c):
            for y in c[i + 1 :]:
                want[x, y] = want.get((x, y), 0) + 1
    df = history.cochange_pairs(changes)
    assert {(r.left_path, r.right_path): r.n for r in df.collect()} == want  # rows of changes may repeat
    assert "REPARTITION_BY_NUM" in _plan(df) and history.pair_tasks(changes) > 100  # of at most 45 pairs a commit with its repeated rows
    imports = spark.createDataFrame([("p01", "p02"), ("p05", "p04"), ("p03", "p03")], "src string, dst string")
    both = {(x, y, n) for (a, b), n in want.items() for x, y in ((a, b), (b, a)) if (x, y) not in {("p01", "p02"), ("p05", "p04")}}
    assert {tuple(r) for r in cards.cochange_minus_imports(df, imports).collect()} == both
    paths = sorted({p for c in commits for p in c})
    files = spark.createDataFrame([(p,) for p in [*paths, "alone"]], "file string")
    got = {r.file: r.co_changes for r in cards.file_cards(files, spark.createDataFrame([], "file string, name string"), imports, df).collect()}
    assert got == {p: sorted(y for x, y, _ in both if x == p) for p in [*paths, "alone"]}


def test_import_rules_run_once_in_many_tasks(spark, monkeypatch):
    from lodestone.sources import parse

    seen = []
    monkeypatch.setattr(parse, "held", lambda df, tag: seen.append(df) or df)
    refs = spark.createDataFrame([("rust", "c/src/a.rs", "super::b::X"), ("rust", "c/src/a.rs", "crate::b"), ("python", "p/a.py", ".b")], "language string, path string, target string").coalesce(1)
    files = spark.createDataFrame([("c/src/b.rs",), ("p/b.py",)], "path string")
    got = sorted(tuple(r) for r in parse.imported_files(refs, files).collect())
    assert ("c/src/a.rs", "crate::b", "c/src/b.rs") in got and ("p/a.py", ".b", "p/b.py") in got
    assert [df.rdd.getNumPartitions() for df in seen] == [4 * spark.sparkContext.defaultParallelism]


def _beside_sql(spark, tmp_path, name):
    import duckdb

    long = "".join(f"{i:08}" for i in range(40_000))  # 10,000 shingles
    rows = [(1, long), (2, long[:9000] + "x" * 18_000 + long[27_000:]), (3, long[:9000] + "y" * 200_000 + long[209_000:]), (4, "short"), (5, None), (6, ""), (7, "é😀\n\r" * 8), (8, "é😀\n\r" * 16), (9, long)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(catalog.ORACLES[name]).fetchall())
    return got


def test_likeness_of_whole_texts(spark, tmp_path):
    got = _beside_sql(spark, tmp_path, "sampled_shingle_dups")
    assert [r[:2] for r in got] == [(1, 2), (1, 9), (2, 9), (7, 8)] and got[0][2] < 0.95  # the middle counts


def test_whole_texts_are_shingled(spark, tmp_path):
    got = dict(_beside_sql(spark, tmp_path, "sampled_shingles"))
    assert got[1] == 10_000 and got[4] == got[6] == 0 and got[7] == 1 and 5 not in got


def test_similar_sets_are_all_found(spark, monkeypatch):
    import random

    monkeypatch.setattr(similarity, "MET_AT_ONCE", 3)
    monkeypatch.setattr(similarity, "SORTED_AT_ONCE", 7)
    monkeypatch.setattr(similarity, "BUCKETS", (4, 4))
    draw = random.Random(7)
    some = [[draw.randrange(-30, 30) for _ in range(draw.randrange(0, 14))] for _ in range(60)]
    near = [[*range(100, 130), 200 + i] for i in range(12)]
    sets = {i: set(x) for i, x in enumerate([*some, *some[:9], *near, *near[:2], *near[:2]])}
    df = spark.createDataFrame([(i, list(x)) for i, x in sets.items()], "file long, set array<long>")
    for t in (0.25, 0.72, 1.0):
        got = [tuple(r) for r in similarity.similar_sets(df, t).collect()]
        want = {(a, b): len(x & y) / len(x | y) for a, x in sets.items() for b, y in sets.items() if a < b and x & y and len(x & y) / len(x | y) >= t}
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want


def test_both_sides_of_hot_keys_are_dealt(spark):
    left, right = spark.createDataFrame([("k", i) for i in range(50)] + [("l", 0), ("n", 0)], "key string, a int"), spark.createDataFrame([("k", i, i % 3) for i in range(70)] + [("l", 1, None), ("m", 2, 2)], "key string, b int, c int")
    df = scratch.hot_pairs(left, right, "key", 10, 10)
    assert sorted(map(str, df.select("key", "a", "b", "c").collect())) == sorted(map(str, left.join(right, "key").select("key", "a", "b", "c").collect()))
    sizes = sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())
    assert df.rdd.getNumPartitions() == 18 and len(sizes) > 6 and sizes[-1] < 1500  # of 3501 pairs, about 200 a task
    assert scratch.hot_pairs(left.limit(0), right, "key").count() == 0


def test_risks_are_told_before_pairs(spark):
    files = spark.createDataFrame([(f"a/s{i}.py",) for i in range(30)] + [(f"a/tests/t{i}.py",) for i in range(30)] + [("a/tests/s1_test.py",), ("b/s1.py",), ("b/s1.py",)], "path string")
    symbols = spark.createDataFrame([(i, f"a/s{i}.py", f"f{i}") for i in range(30)] + [(100 + i, f"a/tests/t{i}.py", "helper" if i % 2 else "test_it") for i in range(29)] + [(200, "a/tests/s1_test.py", "TestOne"), (201, "a/tests/s1_test.py", None), (300, "b/s1.py", "g")], "id long, path string, name string")
    calls = spark.createDataFrame([(100, 0), (100, 0), (100, 7), (101, 100), (200, 300), (201, 1), (None, 2), (300, 200), (5, 999)], "src long, dst long")
    df = cards.test_surface_of(files, symbols, calls)
    want = cards.test_surface(cards.test_pairs(files), symbols, calls, ordered=False)
    assert sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.where("risk = 0.9").count() == 4
    assert "hashpartitioning(source" not in _plan(df) and "hashpartitioning(symbol" not in _plan(df)  # only what precedes the pairs


def test_many_keys_are_replayed_in_few_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(keyed, "ROWS_A_FILE", 10)
    rows = spark.range(120).select(F.concat(F.lit("b"), F.col("id") % 11).alias("branch"), F.timestamp_seconds(F.col("id") * 60 + 86400).alias("ts"), F.concat(F.lit("h"), F.floor(F.col("id") / 30)).alias("head"))
    got = keyed.replayed(rows, keyed.moved_heads, keyed.MOVES, f"file://{tmp_path}/r")
    assert sorted((r.branch, r.head) for r in got.collect()) == sorted((f"b{b}", f"h{h}") for b in range(11) for h in range(4))
    assert len(list(tmp_path.glob("r/in/part=*"))) == 13  # twelve of them, and the end
    batches = sorted(int(x.name) for x in tmp_path.glob("r/cp/commits/[0-9]*"))
    assert len(batches) <= 5, batches  # three, the end, and one for the timers


def test_a_timer_is_set_once_and_waits_on(spark, tmp_path):
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    kinds = {
        "heads": (keyed.moved_heads, "branch string, ts timestamp, head string", [[("b", day(0), "x"), ("c", day(1), "x")], [("b", day(20), "x")], [("b", day(45), "x")], [("c", day(90), "x")], [("c", day(91), "x")], [("b", day(100), "x")], [("late", day(900), "x")], [("late", day(901), "x")]], [("b", 0), ("b", 100), ("c", 1), ("late", 900)]),
        "writes": (lambda s: keyed.unsuppressed(s, timedelta(days=30)), "path string, ts timestamp, id long, own boolean", [[("b", day(0), None, True), ("c", day(1), None, True)], [("b", day(20), 1, True)], [("b", day(45), 2, False), ("c", day(45), 3, False)], [("b", day(100), 4, False)], [("late", day(900), 5, False)], [("late", day(901), 6, False)]], [(3, 45), (4, 100), (5, 900), (6, 901)]),
    }
    for name, (watch, schema, batches, want) in kinds.items():
        for k, v in keyed.STATE_STORE.items():
            spark.conf.set(k, v)
        for i, b in enumerate(batches):
            spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/in/part={i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}/in")
        q = watch(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}/cp").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
        for k in keyed.STATE_STORE:
            spark.conf.unset(k)
        assert sorted((r[0], (r.ts - datetime(2024, 1, 1)).days) for r in spark.table(name).collect()) == want
        assert max(kept) > kept[-1] and kept[-1] <= 4, (name, kept)


def test_an_event_is_replayed_once(spark, monkeypatch, tmp_path):
    rows = [(1, 7, datetime(2024, 1, 1), "view"), (2, 7, datetime(2024, 1, 2), "error"), (3, 7, datetime(2024, 1, 3), None)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    seen = []
    monkeypatch.setattr(keyed, "replayed", lambda rows, *more: seen.append(rows) or rows)
    catalog.QUERIES["replayed_suppression"](spark, str(tmp_path))
    assert sorted((r.id, r.own) for r in seen[0].collect()) == [(1, False), (2, True), (3, False)]
