"""Indexed search gives the rows of a scan, whatever the pattern; a missing index is an error."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import postings
from lodestone.operators.search import lexical
from lodestone.sources import files as sources

WORDS = ["parse", "Config", "tokenİze", "Kelvin", "ÉTÉ", "été", "Σας", "x", "a_b", "fn", "->", "😀ok", "AbCdEf", "", "\t"]


@pytest.fixture(scope="module")
def tables(spark):
    draw = random.Random(5)
    rows = [("r%d" % (k % 2), f"src/f{k}.rs", "\n".join(" ".join(draw.choices(WORDS, k=draw.randint(0, 6))) for _ in range(draw.randint(1, 5)))) for k in range(40)]
    rows += [("r0", "empty.rs", ""), ("r0", "null.rs", None), (None, "long.rs", "ab" * 200_000 + "needle in hay"), ("r1", "src/f1.rs", "the same file again: parse")]
    files = spark.createDataFrame(rows, "root_id string, path string, content string")
    lines = files.select("root_id", "path", F.posexplode(F.split("content", "\n")).alias("line_number", "line"))
    return files, lines


def _rows(df):
    return sorted(map(str, df.select("root_id", "path", "line_number", "line").collect()))


@pytest.mark.parametrize("ignore_case", [False, True])
def test_many_needles(spark, tables, ignore_case):
    files, lines = tables
    needles = ["parse", "PARSE", "k", "K", "i", "İ", "été", "ÉTÉ", "->", "x a", "😀", "ok A", "needle", "no such thing", "a\nb", "", None, "parse", "ς", "bab"]
    got = postings.search_many(lines, postings.postings(files), spark.createDataFrame([(n,) for n in needles], "needle string"), ignore_case=ignore_case).collect()
    for n in set(needles):
        want = _rows(lexical(lines, n, literal=True, ignore_case=ignore_case)) if n else []
        assert sorted(str(r) for r in spark.createDataFrame([tuple(r)[1:] for r in got if r.needle == n], lines.schema).collect()) == want if want else not [r for r in got if r.needle == n], n


def test_required_grams():
    all_of = lambda *xs: [frozenset(xs)]
    assert postings.required("Parse") == all_of("par", "ars", "rse")
    assert postings.required("a.*bc+d") == all_of("a", "b", "c", "d")
    assert set(postings.required("(foo|bar)baz")) == {frozenset({"foo", "baz"}), frozenset({"bar", "baz"})}
    assert postings.required("(foo)?x{2,}") == all_of("x")
    for says_nothing in ("[ab]+", "foo|", "a*", r"\p{L}+foo(", r"\012foo", ".", ""):
        assert postings.required(says_nothing) == [frozenset()], says_nothing
    assert postings.required("(?i)éab") == [frozenset()] and postings.required("(?i)abcé") == all_of("abc")


def test_patterns_by_a_kept_index(spark, tables, tmp_path):
    files, lines = tables
    where = f"file://{tmp_path}/index"
    with pytest.raises(FileNotFoundError, match="no lexical index"):
        postings.search_index(spark, where, "x")
    postings.save_postings(files, lines, where)
    for pattern in ["parse|Config", "(?i)CONFIG +x", "[a-z]_b", "Kel?vin", "fn.*->", "^parse", "x{1,2}$", "need[lm]e in", "zzz", "a|b|c|d|e|f|g|h|i|j|k|l|m|n|o|p|q|r", r"(ab){3,}n", r"\bfn\b", r"😀ok", "été|ÉTÉ", "(?i)tokeni"]:
        assert _rows(postings.search_index(spark, where, pattern)) == _rows(lexical(lines, pattern)), pattern
    for text in ["->", "a_b", "x", ".", "été", "("]:
        assert _rows(postings.search_index(spark, where, text, literal=True, ignore_case=True)) == _rows(lexical(lines, text, literal=True, ignore_case=True)), text
    assert postings.search_index(spark, where, "parse", path="src/", limit=3).count() == 3


def test_a_search_of_few_grams_skips_most_of_the_postings(spark, tables, tmp_path):
    files, lines = tables
    postings.save_postings(files, lines, f"file://{tmp_path}/index")
    plan = postings.search_index(spark, f"file://{tmp_path}/index", "needle")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[.*In\(gram", plan) or re.search(r"PushedFilters: \[.*gram", plan)


def test_index_follows_discovery(spark, tmp_path):
    repo = tmp_path / "repo"
    for path, body in {"src/lib.rs": b'pub fn visible_symbol() { println!("visible token"); }\n', "docs/guide.md": b"# Guide\nThis file mentions visible token in docs.\n", "docs/secret.env": b"API_TOKEN=secret token\n", "docs/blob.bin": bytes([0, 159, 146, 150]), "src/ignored.rs": b"ignored token\n"}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_bytes(body)
    found = sources.discover(spark, str(repo), redact=("**/*.env",)).where(~sources.ignored(F.col("path"), ("src/ignored.rs",))).where("content IS NOT NULL")
    lines = found.select("root_id", "path", F.posexplode(F.split("content", "\n")).alias("line_number", "line"))
    where = f"file://{tmp_path}/index"
    postings.save_postings(found, lines, where)
    assert {r.path for r in postings.search_index(spark, where, "visible token").collect()} == {"src/lib.rs", "docs/guide.md"}
    assert postings.search_index(spark, where, "ignored token").count() == 0 and postings.search_index(spark, where, "secret token").count() == 0
