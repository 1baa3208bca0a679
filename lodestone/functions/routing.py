"""What a task asks for, by the words in it, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Routes by order of trial, with the phrases that lead to each.
ROUTES = {
    "llm-required": ("add type", "add types", "type annotation", "typescript type", "try/catch", "try catch", "error handling", "async await", "async/await", ".then", "promise chain"),
    "var-to-const": ("var to const", "var-to-const", "let to const"),
    "remove-debug-logging": ("remove console", "strip console", "remove debug log", "debug logging"),
    "replace-literal": ("replace literal", "replace string literal", "change literal"),
    "rename-local": ("rename local", "local rename"),
    "test-surface": ("test", "tests", "coverage"),
    "risk-review": ("risk", "impact", "break", "depend", "review", "audit", "security", "threat model", "vulnerab", "refactor"),
    "broad-context-question": ("architecture", "architectural", "design", "compare", "proposal", "proposed", "improvement", "improvements"),
    "context-search": ("search", "find", "where", "read", "symbol", "file", "module", "codebase", "repo"),
}
#: How sure each route is; edits depend on the kind of file.
SURE = {"llm-required": 0.86, "replace-literal": 0.68, "rename-local": 0.68, "test-surface": 0.82, "risk-review": 0.78, "broad-context-question": 0.74, "context-search": 0.76}
#: Recipes by order of trial; the signs of the first are matched in the asked case.
PROBES = ("Command::new", "File::create", "TcpStream", "std::process", "unsafe")
RECIPES = {
    "security_review": ("command execution", "security", "vulnerability", "injection", "auth", "crypto"),
    "release_readiness": ("release", "readiness", "ship", "blocker"),
    "fix_test": ("fix test", "failing test", "test failure", "coverage"),
    "trace_call": ("trace", "call path", "call chain", "flow"),
    "explain_symbol": ("public_api", "test_surface", "_card_impl", "card_impl", "symbol", "function", "struct", "explain"),
    "review_module": ("review", "module", "folder", "directory", "audit"),
}


def _any(text: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def task_route(task: Column) -> Column:
    """The first route one of whose phrases the task holds, else ``general``."""
    low, out = F.lower(task), F.lit("general")
    for name, phrases in reversed(ROUTES.items()):
        out = F.when(_any(low, phrases), name).otherwise(out)
    return out


def route_confidence(route: Column, path: Column) -> Column:
    """How sure a route is, of a task about ``path`` or about none (null)."""
    ext = F.coalesce(F.regexp_extract(path, r"\.([^.]*)$", 1), F.lit(""))
    out = F.lit(0.35)
    for name, sure in SURE.items():
        out = F.when(route == name, sure).otherwise(out)
    edits = F.when((route == "var-to-const") & ext.isin("ts", "tsx"), 0.82).when(route == "var-to-const", 0.64)
    return edits.when((route == "remove-debug-logging") & ext.isin("rs", "py", "ts", "tsx", "js", "jsx"), 0.74).when(route == "remove-debug-logging", 0.55).otherwise(out)


def recipe(ask: Column) -> Column:
    """The recipe that answers a question, else ``general``."""
    low, out = F.lower(ask), F.lit("general")
    for name, phrases in reversed(RECIPES.items()):
        out = F.when(_any(low, phrases), name).otherwise(out)
    return F.when(_any(ask, PROBES), "security_review").otherwise(out)


def source_rank(path: Column) -> Column:
    """4 for sources, 3 for tests among them, 2 for tests, 1 for documentation, 0 else."""
    low = F.lower(path)
    test = low.rlike(r"(^|/)tests/|_test\.|\.test\.|(^|/)tests\.rs$")
    return F.when(low.rlike("(^|/)src/"), F.when(test, 3).otherwise(4)).when(low.rlike("(^|/)tests/"), 2).when(low.startswith("docs/") | low.startswith("openspec/"), 1).otherwise(0)


def ttl_seconds(raw: Column) -> Column:
    """Seconds of a duration such as 30d (m, h, d, w); null if it isn't one or is 0."""
    t = F.trim(raw)
    n = F.try_to_number(F.regexp_extract(t, "^([0-9]{1,12})[mhdw]$", 1), F.lit("999999999999")).cast("long")
    unit = F.substring(t, -1, 1)
    return F.when(n > 0, n * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(604800))


def normal_path(path: Column) -> Column:
    """A path without ``.`` and empty parts, each ``..`` taking back the part before it."""
    step = lambda a, p: F.when(p.isin("", "."), a).when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == "..", a).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def glob_prefix(glob: str) -> str:
    """The folders of a glob before its first sign, which a scan can be cut to."""
    head = glob[: next((i for i, c in enumerate(glob) if c in "*?[{"), len(glob))]
    return head if head == glob else head[: head.rfind("/") + 1]


def file_route(path: Column) -> Column:
    """The route that a file stands for by where it is, null if none: ``app/routes`` files, whose dots part segments, and ``src/routes`` folders with a page or server file.

    ``$x`` and ``[x]`` are parameters, ``_x`` and ``(x)`` group without a segment, ``_index`` ends a route.
    """
    stem = F.regexp_extract(path, r"^(?:.*/)?app/routes/([^/]+?)(?:/route)?\.(?:tsx|jsx|ts|js)$", 1)
    folder = F.regexp_extract(path, r"^(?:.*/)?src/routes((?:/[^/]+)*)/\+(?:page|server|page\.server)\.(?:svelte|ts|js)$", 1)
    dotted = F.filter(F.split(stem, r"\."), lambda s: ~s.startswith("_"))
    params = F.transform(dotted, lambda s: F.when(s == "$", "*").when(s.startswith("$"), F.concat(F.lit(":"), F.substring(s, 2, 1 << 20))).otherwise(F.regexp_replace(s, "_$", "")))
    nested = F.filter(F.split(folder, "/"), lambda s: (s != "") & ~s.rlike(r"^\(.*\)$"))
    named = F.transform(nested, lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\.\.\.(.+)\]$", "*"), r"^\[+(.+?)\]+$", ":$1"))
    return F.when(stem != "", F.concat(F.lit("/"), F.array_join(params, "/"))).when(path.rlike(r"(^|/)src/routes(/[^/]+)*/\+(page|server|page\.server)\.(svelte|ts|js)$"), F.concat(F.lit("/"), F.array_join(named, "/")))
