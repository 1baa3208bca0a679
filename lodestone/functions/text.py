"""Scalar functions on text and paths, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions of each source language.
LANGUAGES = {
    "rust": ("rs",),
    "python": ("py",),
    "typescript": ("ts",),
    "tsx": ("tsx",),
    "go": ("go",),
    "javascript": ("js", "jsx", "mjs", "cjs"),
    "java": ("java",),
    "kotlin": ("kt", "kts"),
    "csharp": ("cs",),
    "php": ("php",),
    "ruby": ("rb",),
    "swift": ("swift",),
    "c": ("c", "h"),
    "cpp": ("cpp", "hpp", "cc", "cxx"),
    "dart": ("dart",),
}
#: Words that say nothing in a query.
STOPWORDS = ("a", "add", "an", "and", "are", "as", "at", "be", "by", "codebase", "for", "from", "in", "into", "is", "it", "likely", "of", "on", "or", "our", "review", "risk", "risks", "that", "the", "this", "to", "with")


def _first(pairs: list[tuple[Column, Column | str]], otherwise=None) -> Column:
    out = F.lit(otherwise)
    for test, value in reversed(pairs):
        out = F.when(test, value).otherwise(out)
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    e = extension(path)
    return _first([(e.isin(*exts), F.lit(name)) for name, exts in LANGUAGES.items()])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_test_path(path: Column) -> Column:
    name = file_name(path)
    return path.rlike(r"(^|/)(tests|__tests__)(/|$)") | (name == "tests.rs") | name.rlike(r"^test_|_tests?\.|\.test\.|\.spec\.")


def within_root(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or under it; "." and "" hold all."""
    root = root.strip("/")
    return F.lit(True) if root in ("", ".") else (path == root) | path.startswith(root + "/")


def glob_to_regex(glob: str) -> str:
    """``**`` goes over folders, ``*`` and ``?`` stay in one, ``{a,b}`` and ``[..]`` are choices."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 2
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body) + "]", end
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "\\" + c if c in r"\.^$+()|{}[]" else c
        i += 1
    return f"^{out}$"


def path_matches(path: Column, pattern: str | None) -> Column:
    """No pattern matches all; one without glob signs is a prefix."""
    if not (pattern or "").strip():
        return F.lit(True)
    return path.rlike(glob_to_regex(pattern)) if any(c in pattern for c in "*?[{") else path.startswith(pattern)


def redacted(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path or a folder above it matches any of the globs; those without a slash match at any depth."""
    tests = []
    for g in globs:
        body = glob_to_regex(g)[1:-1]
        tests.append(path.rlike(("^" if "/" in g.rstrip("/") else "(^|/)") + body.rstrip("/") + "(/|$)"))
    return F.greatest(F.lit(False), F.lit(False), *tests)


def line_count(text: Column) -> Column:
    """Newlines, and one more if the text doesn't end in one; an empty text has none."""
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(n + F.when(text.endswith("\n"), 0).otherwise(1))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.floor(F.octet_length(text) / 3), F.lit(1))


def savings_ratio(raw: Column, card: Column) -> Column:
    """The share of raw tokens that a card saves, never below 0."""
    return F.when(raw > 0, F.greatest(raw - card, F.lit(0)) / raw).otherwise(F.lit(0.0))


def short_name(qualified: Column) -> Column:
    return F.element_at(F.split(qualified, "::|[.:]"), -1)


def split_identifier(name: Column) -> Column:
    """The small words of snake, camel and acronym names, without stopwords."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Za-z0-9])([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[ _\-/.:]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))


def singular(word: Column) -> Column:
    n = F.length(word)
    return F.when((n > 4) & word.endswith("ies"), F.concat(F.substring(word, F.lit(1), n - 3), F.lit("y"))).when((n > 3) & word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), n - 1)).otherwise(word)


def plural(word: Column) -> Column:
    """The plural of a word of more than two letters that isn't one already."""
    n = F.length(word)
    made = F.when(word.rlike("[^aeiou]y$"), F.concat(F.substring(word, F.lit(1), n - 1), F.lit("ies"))).when(word.rlike("(x|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))
    return F.when((n < 3) | word.endswith("s"), word).otherwise(made)


def light_stem(word: Column) -> Column:
    n = F.length(word)
    return F.when((n > 6) & word.endswith("ing"), F.substring(word, F.lit(1), n - 3)).when((n > 5) & word.endswith("ed"), F.substring(word, F.lit(1), n - 2)).otherwise(singular(word))


def query_tokens(text: Column) -> Column:
    """Distinct singular words of ASCII letters and digits, without stopwords, in order."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.array_distinct(F.transform(words, singular))


def phrases(tokens: Column) -> Column:
    """Windows of two and three tokens, as phrases and as snake names."""
    def windows(k: int, glue: str) -> Column:
        return F.when(F.size(tokens) >= k, F.transform(F.sequence(F.lit(1), F.size(tokens) - (k - 1)), lambda i: F.array_join(F.slice(tokens, i, k), glue))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(windows(3, "_"), windows(3, " "), windows(2, "_"), windows(2, " ")))


def code_shaped(token: Column) -> Column:
    mixed = token.rlike("[a-z]") & token.rlike("[A-Z]") & ~token.rlike("^[A-Z][a-z]+$")
    return token.rlike(r"[_\-/.]|::") | mixed | token.rlike("^[A-Z][A-Z0-9]+$")


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def preview(text: Column, n: int = 160) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def cut_at_word(text: Column, n: int = 512) -> Column:
    """At most n characters, cut at the last space among them if there is one."""
    head = F.substring(text, 1, n)
    return F.when(F.length(text) <= n, text).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*) ", 1), F.lit("")), head))


def classify_content(path: Column, size: Column, content: Column, max_size: int = 1 << 20) -> Column:
    """skipped_*, or the class of a file by its text: supported (a known language), markdown, notebook or text."""
    e = extension(path)
    return _first(
        [
            (size == 0, F.lit("skipped_empty")),
            (size > max_size, F.lit("skipped_large")),
            (content.startswith("version https://git-lfs.github.com/spec/"), F.lit("skipped_lfs")),
            (content.contains("\x00") | (F.length(F.regexp_replace(content, "[^\\x01-\\x08\\x0E-\\x1F\\x7F]+", "")) * 5 >= F.length(content)), F.lit("skipped_binary")),
            (language_of(path).isNotNull(), F.lit("supported")),
            (e.isin("md", "markdown", "mdx"), F.lit("markdown")),
            (e == "ipynb", F.lit("notebook")),
        ],
        "text",
    )


def entry_point_kind(qname: Column, path: Column, kind: Column) -> Column:
    """binary, cli_command, http_handler or lib_root by the first rule that holds, else null."""
    name = F.element_at(F.split(qname, "::"), -1)
    binary = (path == "src/main.rs") | path.rlike(r"^src/bin/.*\.rs$") | (path == "lib/main.dart") | path.rlike(r"^bin/.*\.dart$")
    return _first(
        [
            ((qname == "main") & binary, F.lit("binary")),
            ((kind == "function") & path.rlike("(^|/)(cli|command|cmd)(/|$)"), F.lit("cli_command")),
            (name.rlike("^(handle|serve|route)_") | path.rlike("(^|/)(handler|route|router)(/|$)") & kind.isin("function", "method"), F.lit("http_handler")),
            (((path == "src/lib.rs") | path.endswith("/mod.rs")) & kind.isin("function", "class") & ~qname.contains("::"), F.lit("lib_root")),
        ]
    )


def call_path_entry(qname: Column, path: Column, kind: Column) -> Column:
    """The looser test of entry points that call paths use."""
    return ((qname == "main") & (path.endswith("src/main.rs") | path.contains("src/bin/"))) | ((kind == "function") & (F.lower(path).rlike("/(cli|command|cmd)/") | qname.rlike("^(handle|serve|route)_"))) | ((path.endswith("lib.rs") | path.endswith("mod.rs")) & ~qname.contains("::"))


def markdown_title(text: Column) -> Column:
    return F.regexp_extract(text, r"(?m)^# +(.+?)\s*$", 1)


def front_matter(text: Column, field: str) -> Column:
    """A scalar of the block between the first two lines of ---."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---", 1)
    return F.regexp_extract(block, rf"(?m)^{field}: *(.*?)\s*$", 1)


def decision_markers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"DECISION: *([^\n]+)"), F.lit(1))
