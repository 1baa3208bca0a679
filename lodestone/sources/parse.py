"""What sources declare, import and call, by patterns of each language, as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import routing, text
from .scratch import held, hot_join

_NAME = r"([A-Za-z_$][\w$]*)"
_MODIFIERS = r"((?:(?:public|private|protected|internal|fileprivate|open|static|final|abstract|override|sealed|data|suspend|inline|virtual|async|export|default|declare) +)*)"
#: By language: lines of documentation before a declaration, and the declaration with its modifiers, keyword, name and the rest of its line.
_SLASH, _BLOCK, _HASH = r"((?:^[ \t]*///?[^\n]*\n)*)", r"((?:^[ \t]*/\*\*(?:[^*]|\*(?!/))*\*/[ \t]*\n)?)", r"((?:^[ \t]*#[^\n]*\n)*)"
DECLARATIONS = {
    "rust": _SLASH + r"^[ \t]*(pub(?:\([a-z]+\))? +)?(?:async +|unsafe +|const +)*(fn|struct|enum|trait|mod|const|type) +" + _NAME + r"([^\n{;]*)",
    "python": _HASH + r"^[ \t]*()(?:async +)?(def|class) +" + _NAME + r"([^\n:]*)",
    "typescript": _BLOCK + r"^[ \t]*" + _MODIFIERS + r"(function|class|interface|type|enum|const) +" + _NAME + r"([^\n{;]*)",
    "go": _SLASH + r"^()(func|type) +(?:\([^)]*\) *)?" + _NAME + r"([^\n{]*)",
    "java": _BLOCK + r"^[ \t]*" + _MODIFIERS + r"(class|interface|enum|record|void|int|long|boolean|double|String) +" + _NAME + r"([^\n{;]*)",
    "kotlin": _BLOCK + r"^[ \t]*" + _MODIFIERS + r"(fun|class|interface|object|val) +" + _NAME + r"([^\n{=]*)",
    "csharp": _SLASH + r"^[ \t]*" + _MODIFIERS + r"(class|interface|struct|enum|record|void|int|string|bool) +" + _NAME + r"([^\n{;]*)",
    "php": _BLOCK + r"^[ \t]*" + _MODIFIERS + r"(function|class|interface|trait) +" + _NAME + r"([^\n{;]*)",
    "ruby": _HASH + r"^[ \t]*()(def|class|module) +" + _NAME + r"([^\n]*)",
    "swift": _SLASH + r"^[ \t]*" + _MODIFIERS + r"(func|class|struct|enum|protocol) +" + _NAME + r"([^\n{]*)",
    "c": _SLASH + r"^(static +)?(struct|enum|void|int|char|double|long) +\*?" + _NAME + r"( *\([^\n;{]*\)| *(?=\{))",
    "dart": _SLASH + r"^[ \t]*()(class|mixin|enum|void|int|String|bool) +" + _NAME + r"([^\n{;]*)",
}
DECLARATIONS |= {"tsx": DECLARATIONS["typescript"], "javascript": DECLARATIONS["typescript"], "cpp": DECLARATIONS["c"]}
#: Kinds by keyword; a type before a name makes a function or method.
KINDS = {
    "class": ("class", "struct", "enum", "record", "object", "protocol", "mixin"), "trait": ("trait",), "interface": ("interface",), "module": ("mod", "module"),
    "constant": ("const", "val"), "type": ("type",), "function": ("fn", "def", "function", "func", "fun", "void", "int", "long", "boolean", "double", "String", "string", "bool", "char"),
}
IMPORTS = {
    "rust": r"(?m)^[ \t]*(?:pub +)?use +([\w:]+)", "python": r"(?m)^[ \t]*(?:from|import) +([\w.]+)", "typescript": r"(?m)^[ \t]*(?:import|export)[^\n\"']*[\"']([^\"'\n]+)[\"']", "go": r"(?m)^(?:import +|[ \t]+)(?:\w+ +)?\"([^\"\n]+)\"",
    "java": r"(?m)^import +(?:static +)?([\w.]+)", "kotlin": r"(?m)^import +([\w.]+)", "csharp": r"(?m)^[ \t]*using +([\w.]+)", "php": r"(?m)^use +([\w\\]+)", "ruby": r"(?m)^require(?:_relative)? +[\"']([^\"'\n]+)[\"']",
    "swift": r"(?m)^import +([\w.]+)", "c": r"(?m)^#include +[<\"]([^>\"\n]+)[>\"]", "dart": r"(?m)^import +[\"']([^\"'\n]+)[\"']",
}
IMPORTS |= {"tsx": IMPORTS["typescript"], "javascript": IMPORTS["typescript"], "cpp": IMPORTS["c"]}
#: Words before a bracket that call nothing.
KEYWORDS = ("if", "for", "while", "switch", "match", "return", "catch", "fn", "def", "func", "fun", "function", "class", "elif", "and", "or", "not", "in", "sizeof", "loop", "pub")


def _by_language(language: Column, of: dict, otherwise: Column) -> Column:
    return reduce(lambda rest, kv: F.when(language == kv[0], kv[1]).otherwise(rest), of.items(), otherwise)


def visibility(language: Column, modifiers: Column, name: Column) -> Column:
    """public, crate, protected or private by the rule of each language."""
    said = F.when(modifiers.rlike("private|fileprivate"), "private").when(modifiers.contains("protected"), "protected").when(modifiers.contains("public") | modifiers.contains("open"), "public")
    rules = {
        "rust": F.when(modifiers.rlike(r"pub *\("), "crate").when(modifiers.contains("pub"), "public").otherwise("private"),
        "go": F.when(name.rlike("^[A-Z]"), "public").otherwise("private"),
        "java": F.coalesce(said, F.lit("crate")), "csharp": F.coalesce(said, F.lit("private")), "swift": F.coalesce(said, F.lit("crate")), "kotlin": F.coalesce(said, F.lit("public")), "php": F.coalesce(said, F.lit("public")),
        "c": F.when(modifiers.contains("static"), "private").otherwise("public"), "cpp": F.when(modifiers.contains("static"), "private").otherwise("public"),
    }
    rules |= {lang: F.when(modifiers.contains("export"), "public").otherwise("private") for lang in ("typescript", "tsx", "javascript")}
    return _by_language(language, rules, F.when(name.startswith("_"), "private").otherwise("public"))


def declarations(files: DataFrame) -> DataFrame:
    """path, language, position, kind, name, visibility, signature, doc of what files (path, content) declare."""
    f = files.select("path", "content", text.language_of(F.col("path")).alias("language")).where("language IS NOT NULL")
    none = F.array().cast("array<string>")
    group = lambda i: _by_language(F.col("language"), {lang: F.regexp_extract_all("content", F.lit("(?m)" + p), F.lit(i)) for lang, p in DECLARATIONS.items()}, none)
    found = f.select("path", "language", F.posexplode(F.arrays_zip(*[group(i).alias(n) for i, n in enumerate(("doc", "modifiers", "keyword", "name", "rest"), 1)])).alias("position", "d")).select("path", "language", "position", "d.*")
    word = F.col("keyword")
    kind = reduce(lambda rest, kv: F.when(word.isin(*kv[1]), kv[0]).otherwise(rest), KINDS.items(), F.lit("function"))
    doc = F.trim(F.regexp_replace(F.regexp_replace("doc", r"(?m)^[ \t]*(///?|#|/?\*+/?)[ \t]?|[ \t]*\*+/[ \t]*$", ""), r"\s+", " "))
    signature = F.trim(F.concat_ws("", word, F.lit(" "), "name", F.rtrim("rest")))
    return found.select("path", "language", "position", kind.alias("kind"), "name", visibility(F.col("language"), F.col("modifiers"), F.col("name")).alias("visibility"), signature.alias("signature"), F.nullif(doc, F.lit("")).alias("doc"))


def import_refs(files: DataFrame) -> DataFrame:
    """path, language, target of the imports in files (path, content)."""
    f = files.select("path", "content", text.language_of(F.col("path")).alias("language"))
    found = _by_language(F.col("language"), {lang: F.regexp_extract_all("content", F.lit(p), F.lit(1)) for lang, p in IMPORTS.items()}, F.array().cast("array<string>"))
    return f.select("path", "language", F.explode(F.array_distinct(found)).alias("target"))


def call_refs(files: DataFrame) -> DataFrame:
    """path, name, n of the names that files (path, content) call: those before a bracket, but for keywords, less the times that a declaration there has the name so."""
    f = files.select("path", "content", text.language_of(F.col("path")).alias("language")).where("language IS NOT NULL")
    named = f.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?<![\w$])([A-Za-z_$][\w$]*)\("), F.lit(1))).alias("name"))
    named = named.where(~F.col("name").isin(*KEYWORDS)).groupBy("path", "name").agg(F.count("*").alias("n"))
    own = declarations(files).where(F.contains("signature", F.concat("name", F.lit("(")))).groupBy("path", "name").agg(F.count("*").alias("own"))
    return named.join(own, ["path", "name"], "left").select("path", "name", (F.col("n") - F.coalesce("own", F.lit(0))).alias("n")).where("n > 0")


def _rust_candidates(path: Column, target: Column) -> Column:
    """Files of a rust path: from the ``src`` of the importing crate, its own module (``self::``) or one above for each ``super::``; the
    whole path first, then without its last part, which may be an item of the module.  A path above the crate stands for none."""
    src = F.regexp_extract(path, r"^((?:.*/)?src)/", 1)
    inner = F.regexp_replace(F.substring(path, F.length(src) + F.when(src == "", 1).otherwise(2), F.length(path)), r"(^|/)(mod|lib|main)\.rs$|\.rs$", "")
    own = F.filter(F.split(inner, "/"), lambda x: x != "")
    said = F.split(target, "::")
    ups = F.size(F.filter(said, lambda x: x == "super"))
    rest = F.filter(said, lambda x: ~x.isin("crate", "self", "super", ""))
    base = F.when(said[0] == "self", own).when(said[0] == "super", F.when(ups <= F.size(own), F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    full = F.concat(base, rest)
    whole, most = F.array_join(full, "/"), F.array_join(F.slice(full, F.lit(1), F.greatest(F.size(full) - 1, F.lit(0))), "/")
    at = lambda inner, end: F.when(inner != "", F.concat_ws("/", F.nullif(src, F.lit("")), F.concat(inner, F.lit(end))))
    return F.when(F.size(rest) > 0, F.array_compact(F.array(at(whole, ".rs"), at(whole, "/mod.rs"), at(most, ".rs"), at(most, "/mod.rs"))))


def _python_candidates(folder: Column, target: Column) -> Column:
    """Files of a python module, from the root or ``src``; leading dots count from the importing package, one more folder up for each."""
    dots = F.length(F.regexp_extract(target, r"^(\.*)", 1))
    inner = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/")
    beside = F.concat_ws("/", F.nullif(up, F.lit("")), F.nullif(inner, F.lit("")))
    files = lambda base: [F.concat(base, F.lit(".py")), F.concat_ws("/", F.nullif(base, F.lit("")), F.lit("__init__.py"))]
    return F.when(dots == 0, F.array(*files(inner), *files(F.concat(F.lit("src/"), inner)))).when(dots - 1 <= F.size(parts), F.array(*files(beside)))


def go_modules(files: DataFrame) -> DataFrame:
    """folder, module of the go.mod files among files (path, content)."""
    m = files.where(F.col("path").rlike("(^|/)go\\.mod$"))
    return m.select(F.regexp_extract("path", "^(.*)/go\\.mod$", 1).alias("folder"), F.regexp_extract("content", r'(?m)^module[ \t]+"?([^\s"]+)', 1).alias("module")).where("module != ''")


def candidates(language: Column, path: Column, target: Column) -> Column:
    """The paths that an import may stand for, best first; a Go import stands for all files of its folder, as ``folder/*``."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    beside = routing.normal_path(F.concat_ws("/", F.nullif(folder, F.lit("")), target))
    slashed = F.regexp_replace(target, r"\.", "/")
    none = F.array().cast("array<string>")
    ends = lambda base, *xs: F.array(*[F.concat(base, F.lit(x)) for x in xs])
    script = F.when(target.startswith("."), ends(beside, "", ".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js")).otherwise(F.array().cast("array<string>"))
    rules = {lang: script for lang in ("typescript", "tsx", "javascript")}
    rules |= {
        "python": F.coalesce(_python_candidates(folder, target), none),
        "rust": F.coalesce(_rust_candidates(path, target), none),
        "go": ends(F.regexp_replace(target, r"^[^/]+\.[^/]+/[^/]+/[^/]+/", ""), "/*"),
        "java": ends(F.concat(F.lit("src/main/java/"), slashed), ".java"), "kotlin": ends(F.concat(F.lit("src/main/kotlin/"), slashed), ".kt"),
        "dart": F.when(target.startswith("package:"), F.array(F.concat(F.lit("lib/"), F.regexp_replace(target, "^package:[^/]+/", "")))).otherwise(F.array(beside)), "c": F.array(beside, target), "cpp": F.array(beside, target),
    }
    return _by_language(language, rules, F.array(beside))


def imported_files(refs: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """path, target, resolved of import references (path, language, target): the first candidate that is a file (path), or all Go files of a folder.

    With ``modules`` (folder, module, of ``go_modules``) a Go import stands for a folder of the longest module that its path begins with, and for none without one.
    """
    dealt = refs.select("path", "language", "target").repartition(4 * refs.sparkSession.sparkContext.defaultParallelism)  # the rules cost more than the rows
    c = held(dealt.select("path", "target", F.posexplode(candidates(F.col("language"), F.col("path"), F.col("target"))).alias("rank", "candidate")), "import-candidates")
    if modules is not None:
        parts = F.split("target", "/")
        heads = refs.where("language = 'go'").select("path", "target", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("module"))
        met = heads.join(modules, "module").groupBy("path", "target").agg(F.max_by(F.struct("folder", "module"), F.length("module")).alias("m"))
        inside = F.expr("substring(target, length(m.module) + 2)")
        folder = F.concat_ws("/", F.nullif(F.col("m.folder"), F.lit("")), F.nullif(inside, F.lit("")))
        c = c.join(refs.where("language = 'go'").select("path", "target").distinct(), ["path", "target"], "left_anti").unionByName(met.select("path", "target", F.lit(0).alias("rank"), F.concat(folder, F.lit("/*")).alias("candidate")))
    known = files.select(F.col("path").alias("resolved")).distinct()
    one = c.join(known.select("resolved", F.col("resolved").alias("candidate")), "candidate").groupBy("path", "target").agg(F.min_by("resolved", "rank").alias("resolved"))
    folders = known.where(F.col("resolved").endswith(".go")).select("resolved", F.concat(F.regexp_extract("resolved", "^(.*)/[^/]*$", 1), F.lit("/*")).alias("candidate"))
    return one.unionByName(hot_join(c.where(F.col("candidate").endswith("/*")), folders, "candidate").select("path", "target", "resolved"))


def log_records(records: DataFrame) -> DataFrame:
    """revision, author, ts, path of git log records (record) in the form revision, author and ISO time by line, then the changed paths, a line each.

    ``git log --first-parent --name-only --format=%x1e%H%n%an%n%cI`` writes such records apart by \\x1e; read them by
    ``spark.read.option("lineSep", "\\x1e").text(file)``.
    """
    lines = F.filter(F.split("record", "\n"), lambda x: x != "")
    r = records.select(lines.alias("l")).where("size(l) >= 3")
    return r.select(F.col("l")[0].alias("revision"), F.col("l")[1].alias("author"), F.try_to_timestamp(F.col("l")[2]).alias("ts"), F.explode_outer(F.array_distinct(F.slice("l", F.lit(4), F.size("l")))).alias("path"))


def roots(found: DataFrame) -> DataFrame:
    """root_id, kind, location of discovered roots (root_id, kind, location): one of a kind wins over those named later in primary, worktree, submodule, branch."""
    rank = F.array_position(F.array(*map(F.lit, ("primary", "worktree", "submodule", "branch"))), F.col("kind"))
    return found.groupBy("root_id").agg(F.min_by(F.struct("kind", "location"), F.struct(rank.alias("rank"), "location")).alias("r")).select("root_id", "r.kind", "r.location")
