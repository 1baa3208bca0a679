"""Operators on literal rows, where the driver's tables don't reach."""

import pandas as pd
from pyspark.sql import functions as F

from lodestone.functions import sets, text
from lodestone.functions import prose, routing
from lodestone.operators import budget, cards, context, graph, history, lifecycle, overlay, postings, search, similarity, upkeep
from lodestone.sources import files, parse
from lodestone.streaming import watch


def _one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_commits_over_the_cap_form_no_pairs(spark):
    rows = [(1, f"p{i:03}") for i in range(101)] + [(2, "a"), (2, "b"), (3, "a"), (3, "b")]
    got = history.cochange_pairs(spark.createDataFrame(rows, "revision long, path string")).collect()
    assert [tuple(r) for r in got] == [("a", "b", 2)]


def test_empty_set_conventions(spark):
    none, some = F.array().cast("array<int>"), F.array(F.lit(1))
    assert [_one(spark, f(a, b)) for f in (sets.jaccard, sets.jaccard_distance, sets.sample_similarity) for a, b in ((none, none), (some, none))] == [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def test_paths(spark):
    assert _one(spark, text.language_of(F.lit("a/b.RS"))) == "rust"
    assert _one(spark, text.is_test_path(F.lit("src/x_test.go"))) and not _one(spark, text.is_test_path(F.lit("src/x.go")))
    assert _one(spark, text.path_matches(F.lit("a/b/c.py"), "a/**/*.py")) and not _one(spark, text.path_matches(F.lit("a/b/c.py"), "a/*.py"))
    assert _one(spark, text.within_root(F.lit("src/a"), "src")) and not _one(spark, text.within_root(F.lit("srcs/a"), "src"))


def test_identifiers(spark):
    assert _one(spark, text.split_identifier(F.lit("parseHTTPRequest_for-the/files"))) == ["parse", "http", "request", "files"]
    assert [_one(spark, text.light_stem(F.lit(w))) for w in ("queries", "parsing", "parsed", "class", "maps")] == ["query", "pars", "pars", "class", "map"]


def test_line_counts(spark):
    assert [_one(spark, text.line_count(F.lit(t))) for t in ("", "a", "a\n", "a\nb")] == [0, 1, 1, 2]


def test_entry_points(spark):
    kind = lambda q, p, k: _one(spark, text.entry_point_kind(F.lit(q), F.lit(p), F.lit(k)))
    assert [kind("main", "src/main.rs", "function"), kind("run", "src/cmd/a.rs", "function"), kind("a::handle_x", "src/a.rs", "method"), kind("Thing", "src/a/mod.rs", "class"), kind("x", "y.rs", "function")] == ["binary", "cli_command", "http_handler", "lib_root", None]


def test_knapsack_passes_over(spark):
    rows = spark.createDataFrame([("r", 1, 50), ("r", 2, 40), ("r", 3, 10)], "by string, o int, c int")
    assert budget.knapsack(rows, "by", "o", "c", 60).first()["kept"] == [1, 3]


def test_prefix_cut_keeps_the_first(spark):
    rows = spark.createDataFrame([("r", 1, 500), ("r", 2, 1)], "by string, o int, c int")
    assert [r["o"] for r in budget.prefix_cut(rows, "by", ["o"], "c", 60).collect()] == [1]


def test_tiers_and_sections(spark):
    assert [_one(spark, budget.tier(F.lit(x))) for x in (0.95, 0.85, 0.7, 0.6, 0.59)] == ["high", "high", "review_queue", "review_queue", "below_threshold"]
    assert budget.drop_sections([("a", 5), ("b", 5), ("c", 5)], 10, ["b", "a"]) == ["a", "c"]


def test_call_paths_stop_at_entries(spark):
    calls = spark.createDataFrame([("m", "a"), ("a", "t"), ("n", "m"), ("t", "a")], "src string, dst string")
    got = graph.call_paths(calls, spark.createDataFrame([("m",)], "id string"), "t").collect()
    assert [tuple(r) for r in got] == [("m", "m>a>t")]


def test_resolve_calls(spark):
    refs = spark.createDataFrame([("r1", "f", "x.rs", "function", None), ("r2", "g", "x.rs", "function", None)], "ref string, name string, file string, kind string, prefix string")
    symbols = spark.createDataFrame([("s1", "f", "x.rs", "function", "private", "f"), ("s2", "f", "y.rs", "function", "public", "f"), ("s3", "g", "y.rs", "class", "public", "g"), ("s4", "g", "z.rs", "class", "public", "g")], "id string, name string, file string, kind string, visibility string, qualified_name string")
    none = spark.createDataFrame([], "file string, target_file string")
    assert [tuple(r) for r in graph.resolve_calls(refs, symbols, none).collect()] == [("r1", "s1", 130)]


def test_identity_cascade(spark):
    old = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(20, 30)] + [("c", 99)], "file string, element int")
    new = spark.createDataFrame([("a2", i) for i in range(10)] + [("b1", i) for i in range(20, 25)] + [("b2", i) for i in range(25, 30)], "file string, element int")
    got = {r["old"]: (r["outcome"], r["targets"]) for r in similarity.identity_cascade(old, new).collect()}
    assert got == {"a": ("rename", ["a2"]), "b": ("split", ["b1", "b2"]), "c": ("breakage", [])}


def test_quoted_passages_are_contained(spark):
    items = ["the cat sat on the mat tonight", "five words are in here", "two words", "word", "a lone wolf", "", "six is  more than five words", None]
    texts = ['He said "the cat sat on the mat tonight".', "(five words are in here, he said)", "-two words, all wordy", "that's a lone wolf's howl", "six is more than five words", "xsix is  more than five wordsy", "the cat sat on the", None]
    got = search.containment(spark.createDataFrame(list(enumerate(items)), "item_id int, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, d) for i, x in enumerate(items) for d, y in enumerate(texts) if x and y and x in y)


def test_cascade_by_sampled_content_and_git(spark):
    sets_of = lambda rows: spark.createDataFrame(rows, "file string, element int")
    old, new = sets_of([("one", 1), ("git", 5), ("git", 6)]), sets_of([("one2", 2)])
    samples = [("none", i) for i in range(20)] + [("one", i) for i in range(50, 70)] + [("gone", None)], [("none2", i) for i in range(1, 20)] + [("one2", i) for i in range(52, 70)] + [("git2", None)]
    git = spark.createDataFrame([("git", "git2"), ("gone", "nowhere"), ("one", "git2")], "old string, new string")
    got = {r["old"]: (r["outcome"], r["targets"]) for r in similarity.identity_cascade(old, new, sets_of(samples[0]), sets_of(samples[1]), git).collect()}
    assert got == {"none": ("rename", ["none2"]), "one": ("rename", ["one2"]), "git": ("git_rename", ["git2"]), "gone": ("breakage", [])}


def test_sampled_duplicates(spark, tmp_path):
    from lodestone.plans import catalog

    text = "".join(f"{i:05}" for i in range(600))
    rows = [(1, text), (2, text[:-40] + "x" * 40), (3, "y" * 3000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [(r["old"], r["new"]) for r in catalog.QUERIES["sampled_shingle_dups"](spark, str(tmp_path)).collect()] == [(1, 2)]


def test_lcs():
    assert list(similarity.lcs_ratio(pd.Series(["abcd", "abc", ""]), pd.Series(["abxd", "xyz", "a"]))) == [0.75, 0.0, 0.0]


def test_quotes_are_found_deep_in_long_sources(spark):
    source = " ".join(f"w{i * i % 7919}" for i in range(3000))
    words = source.split()
    near, long = words[2500:2530], words[1000:1100]
    near[12] = "other"
    long[40] = "other"
    quotes = [(1, " ".join(near)), (2, " ".join(long)), (3, " ".join(words[2000:2010]).upper()), (4, "nothing of this stands anywhere"), (5, " ".join(words[:1500])), (6, " ".join(words[:20] + ["zzzzzzz"] * 20)), (7, " ")]
    got = {r["id"]: (r["stage"], r["ratio"]) for r in similarity.verify_spans(spark.createDataFrame([(*q, source) for q in quotes], "id int, quoted string, source string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "near", 2: "near", 3: "exact", 4: "missing", 5: "refused", 6: "missing", 7: "refused"}
    assert all(0.9 <= got[k][1] < 1 for k in (1, 2)) and got[5][1] is None


def test_windows_by_brute_force():
    source, needle = "the quick brown fox jumps over the lazy dog and the quick red fox sleeps", "a quick rod fox sleep"
    words = source.split()
    every = [" ".join(words[i : i + w]) for w in range(3, 8) for i in range(len(words) - w + 1)]
    assert similarity.windowed_ratio(source, needle) == max(similarity.lcs_ratio(pd.Series(every), pd.Series([needle] * len(every))))


def test_pending_promotions_recover(spark):
    links = spark.createDataFrame([(1, "a", "b", "pending_promotion"), (2, "a", "c", "pending_promotion"), (3, "x", "y", "rejected")], "link int, src string, dst string, state string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r["link"]: r["state"] for r in overlay.recover_pending(links, edges).collect()} == {1: "promoted", 2: "active", 3: "rejected"}


def test_discover_and_extract(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("class A:\n    def f(self):\n        pass\n")
    (tmp_path / "src/b.bin").write_bytes(b"\x00\x01")
    (tmp_path / "secret.env").write_text("x")
    found = files.discover(spark, str(tmp_path), redact=("*.env",))
    assert {r["path"]: r["class"] for r in found.collect()} == {"src/a.py": "supported", "src/b.bin": "skipped_binary"}
    assert [(r["kind"], r["name"]) for r in parse.declarations(found).orderBy("position").collect()] == [("class", "A"), ("function", "f")]


def test_log_counts_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": 1}\nnot json\n{"id": 2}\n')
    rows, bad = files.read_log(spark, str(tmp_path / "log.jsonl"), "id long")
    assert sorted(r["id"] for r in rows.collect()) == [1, 2]


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    files.export(rows, str(tmp_path / "md"), "markdown")
    assert "- **name**: a" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "md")).collect())


def test_streamed_sessions_equal_batch(spark, tmp_path):
    rows = spark.range(40).select(F.timestamp_seconds(F.col("id") * 60 + F.floor(F.col("id") / 10) * 600).alias("ts"), F.concat(F.lit("p"), F.col("id") % 7).alias("path"), F.lit("r").alias("root"))
    rows.union(spark.sql("SELECT timestamp'2030-01-01' AS ts, 'end' AS path, 'r' AS root")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = watch.sessions(stream, by=("root",)).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("sessions").collect())) == sorted(map(tuple, watch.sessions(rows, by=("root",)).collect()))


def test_rare_elements_find_all_similar_pairs(spark):
    import random

    draw = random.Random(5)
    sets_ = {f"f{i}": {draw.randrange(8) if draw.random() < 0.4 else draw.randrange(40) for _ in range(draw.randrange(1, 12))} for i in range(120)}
    old, new = dict(list(sets_.items())[:60]), dict(list(sets_.items())[60:])
    frame = lambda d: spark.createDataFrame([(f, e) for f, s in d.items() for e in s], "file string, element int")
    for t in (0.25, 0.5, 0.8, 1.0):
        got = {(r["old"], r["new"]) for r in similarity.similar_pairs(frame(old), frame(new), t).collect()}
        assert got == {(a, b) for a, x in old.items() for b, y in new.items() if len(x & y) / len(x | y) >= t}


def test_sessions_join_over_midnight(spark):
    at = [0, 100, 86_300, 86_450, 86_500, 90_000, 172_790, 172_801, 172_802, 259_199, 259_200]
    events = spark.createDataFrame([(x,) for x in at], "s long").select(F.timestamp_seconds("s").alias("ts"))
    want = events.groupBy(F.session_window("ts", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select("w.start", "w.end", "n")
    assert sorted(map(tuple, watch.sessions(events).collect())) == sorted(map(tuple, want.collect()))


def test_neighborhoods_by_kind(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("a", "d", "imports"), ("a", "a", "calls")], "src string, dst string, kind string")
    got = lambda **k: {(r["id"], r["depth"], r["degree"]) for r in graph.neighborhood(edges, "a", 2, **k).collect()}
    assert got(kinds=("calls",)) == {("a", 0, 3), ("b", 1, 2), ("c", 2, 1)}
    assert got(direction="outbound") == {("a", 0, 4), ("b", 1, 2), ("d", 1, 1), ("c", 2, 1)}
    assert graph.neighborhood(edges, "nobody").count() == 0


def test_edge_kinds_and_queries(spark):
    import pytest

    assert cards.edge_kind("CoChangesWith") == cards.edge_kind("co_changes_with") == "co_changes_with"
    with pytest.raises(ValueError):
        cards.edge_kind("likes")
    none = spark.createDataFrame([], "src string, dst string, kind string")
    with pytest.raises(ValueError):
        cards.edges_with_drift(none, spark.createDataFrame([], "file string, score double"), "sideways a")


def test_owners_may_have_names(spark):
    commits = spark.createDataFrame([(1, "zoe", "2024-01-01"), (2, "amy", "2024-01-02")], "revision long, author string, ts string")
    changes = spark.createDataFrame([(1, "x"), (2, "x")], "revision long, path string")
    assert tuple(history.ownership(commits, changes).first()) == ("x", "amy", 1, 2)


def test_durations_paths_and_globs(spark):
    assert [_one(spark, routing.ttl_seconds(F.lit(x))) for x in ("30d", "2w", "0m", "5", "-1d", "")] == [2592000, 1209600, None, None, None, None]
    assert [_one(spark, routing.normal_path(F.lit(x))) for x in ("a/b/../c", "./a//b", "../../x")] == ["a/c", "a/b", "x"]
    assert [routing.glob_prefix(x) for x in ("src/**/*.rs", "src/a.rs", "*.rs", "src/a?.rs")] == ["src/", "src/a.rs", "", "src/"]


def test_notes_without_front_matter(spark):
    t = F.lit("Plain first line\n\n## Context\nwhy\n")
    assert _one(spark, prose.title(t, F.lit("docs/n.md"))) == "n.md" and _one(spark, prose.summary(t)) == "Plain first line" and _one(spark, prose.decision(t)) == "why"
    assert _one(spark, prose.front_list(t, "aliases")) == [] and _one(spark, prose.front_scalar(t, "status")) is None and _one(spark, prose.decision(F.lit(""))) is None


def test_staged_find_stops_when_the_text_itself_is_found(spark):
    lines = spark.createDataFrame([("r", "a.rs", 1, "parse the config"), ("r", "b.rs", 1, "config only")], "root_id string, path string, line_number int, line string")
    tasks = spark.createDataFrame([(1, "parse the config"), (2, "parse nothing config")], "task int, text string")
    index = postings.postings(lines.select("root_id", "path", F.col("line").alias("content")))
    got = {(r["task"], r["attempt"], r["path"]) for r in context.staged_find(lines, index, tasks).collect()}
    assert {x for x in got if x[0] == 1} == {(1, 0, "a.rs")} and {x[2] for x in got if x[0] == 2} == {"a.rs", "b.rs"}


def test_references_that_tie_are_rejected(spark):
    symbols = spark.createDataFrame([("s1", "f", "m::f", "x.rs", "public", "r"), ("s2", "f", "n::f", "y.rs", "public", "r"), ("s3", "g", "m::g", "x.rs", "private", "r")], "id string, name string, qualified_name string, file string, visibility string, root_id string")
    refs = spark.createDataFrame([("a", "f", "z.rs", "r"), ("b", "m::f", "z.rs", "r"), ("c", "g", "x.rs", "r"), ("d", "g", "z.rs", "r"), ("e", "f", "y.rs", "r")], "ref string, target string, file string, root_id string")
    none = spark.createDataFrame([], "file string, target_file string")
    assert sorted(map(tuple, cards.resolve_references(refs, symbols, none).collect())) == [("b", "s1"), ("c", "s3"), ("e", "s2")]


def test_renames_keep_the_rest(spark):
    before = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, body string")
    after = spark.createDataFrame([("x", "1"), ("b", "9"), ("d", "4")], "path string, body string")
    assert sorted(map(str, map(tuple, lifecycle.changed_with_renames(before, after, "path", "body").collect()))) == sorted(map(str, [("a", "renamed", "x"), ("b", "modified", None), ("c", "removed", None), ("d", "added", None)]))


def test_blocked_or_failed_passes_sync_nothing(spark):
    outcomes = spark.createDataFrame([(1, True), (2, False)], "finished int, completed boolean")
    rows = spark.range(3)
    assert upkeep.auto_sync(outcomes, [("s", rows)]).count() == 0 and upkeep.auto_sync(outcomes.where("completed"), [("s", rows)], blocked=True).count() == 0
    assert [tuple(r) for r in upkeep.auto_sync(outcomes.where("completed"), [("s", rows)]).collect()] == [("s", 3)]


def test_ignore_patterns(spark):
    fits = lambda p, *g: _one(spark, files.ignored(F.lit(p), g))
    assert fits("a/b.log", "*.log") and not fits("a/keep.log", "*.log", "!keep.log") and fits("target/x", "target/") and not fits("target", "target/") and not fits("a/docs/x", "/docs")


def test_watch_loop_falls_back_to_full_passes(spark, tmp_path):
    full, steps, after = [], [], []
    rows = spark.createDataFrame([(f"src/f{i}.rs",) for i in range(5)] + [(".git/x",)], "path string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for cap, name in ((10, "few"), (2, "many")):
        q = watch.watch_loop(stream, lambda: full.append(1), lambda b, n: steps.append(b.count()), str(tmp_path / name), cap=cap, after=after.append)
        q.processAllAvailable()
        q.stop()
    assert (len(full), steps, len(after)) == (3, [5], 2)


def test_reads_are_cached_by_revision(spark):
    built = []
    cache = watch.RevisionCache(lambda: built.append(1) or spark.range(3))
    assert cache.at(1).count() == cache.at(1).count() == 3 and len(built) == 1
    cache.at(2)
    assert len(built) == 2


def test_calls_are_not_declarations(spark):
    f = spark.createDataFrame([("a.py", "def run(x):\n    if (x):\n        return run(go(x))\n")], "path string, content string")
    assert sorted(map(tuple, parse.call_refs(f).collect())) == [("a.py", "go", 1), ("a.py", "run", 1)]


def test_imports_of_modules(spark):
    paths = ["src/lib.rs", "src/foo/mod.rs", "src/foo/a.rs", "src/foo/b.rs", "src/bar.rs", "crates/x/src/main.rs", "crates/x/src/deep/in.rs", "pkg/__init__.py", "pkg/a.py", "pkg/sub/__init__.py", "pkg/sub/b.py", "top.py", "svc/go.mod", "svc/util/u.go", "svc/util/v.go", "svc/inner/go.mod", "svc/inner/util/w.go"]
    files = spark.createDataFrame([(p, {"svc/go.mod": "// x\nmodule example.com/svc\n", "svc/inner/go.mod": 'module "example.com/svc/inner"\n'}.get(p, "")) for p in paths], "path string, content string")
    asked = [
        ("rust", "src/foo/a.rs", "self::x", "src/foo/a.rs"), ("rust", "src/foo/a.rs", "super::b::T", "src/foo/b.rs"), ("rust", "src/foo/a.rs", "super::super::bar", "src/bar.rs"), ("rust", "src/foo/a.rs", "super::super::super::bar", None), ("rust", "src/foo/mod.rs", "self::a", "src/foo/a.rs"),
        ("rust", "src/lib.rs", "crate::foo::a::f", "src/foo/a.rs"), ("rust", "src/lib.rs", "foo::Item", "src/foo/mod.rs"), ("rust", "src/lib.rs", "std::fmt", None), ("rust", "src/lib.rs", "crate", None), ("rust", "crates/x/src/main.rs", "crate::deep::in", "crates/x/src/deep/in.rs"),
        ("python", "pkg/sub/b.py", ".", "pkg/sub/__init__.py"), ("python", "pkg/sub/b.py", "..a", "pkg/a.py"), ("python", "pkg/sub/b.py", "..", "pkg/__init__.py"), ("python", "pkg/sub/b.py", "...top", "top.py"), ("python", "pkg/sub/b.py", "....top", None), ("python", "top.py", "pkg.sub.b", "pkg/sub/b.py"),
        ("go", "svc/m.go", "example.com/svc/util", "svc/util/u.go svc/util/v.go"), ("go", "svc/m.go", "example.com/svc/inner/util", "svc/inner/util/w.go"), ("go", "svc/m.go", "example.com/other/util", None), ("go", "svc/m.go", "fmt", None),
    ]
    refs = spark.createDataFrame([a[:3] for a in asked], "language string, path string, target string")
    got = {}
    for r in parse.imported_files(refs, files, parse.go_modules(files)).collect():
        got.setdefault((r.path, r.target), []).append(r.resolved)
    assert {k: " ".join(sorted(x)) for k, x in got.items()} == {(p, t): want for _, p, t, want in asked if want}
