"""Symbols with scopes, body ranges and hashes, and calls by caller, read from sources whose comments and strings are blanked first."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .parse import KEYWORDS, visibility

_LINE, _BLOCK, _DOUBLE, _SINGLE, _TRIPLE = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?', r"'(?:\\.|[^'\\\n])*'?", r'""".*?(?:"""|\Z)'
_C = (_LINE, _BLOCK, _DOUBLE, _SINGLE)
#: What is blanked: comments and strings of each language, in the order of trial.
QUIET = {
    "rust": (_LINE, r"/\*", r'b?r(?P<n>#*)".*?(?:"(?P=n)|\Z)', r'"(?:\\.|[^"\\])*"?', r"'(?:\\[^\n']+|\\'|[^'\\\n])'"),
    "python": (r"#[^\n]*", r'(?P<q>"""|\'\'\').*?(?:(?P=q)|\Z)', _DOUBLE, _SINGLE),
    "typescript": (*_C, r"`(?:\\.|[^`\\])*`?"), "go": (_LINE, _BLOCK, _DOUBLE, r"`[^`]*`?", r"'(?:\\.|[^'\\\n])+'"),
    "java": (_LINE, _BLOCK, _TRIPLE, _DOUBLE, _SINGLE), "csharp": (_LINE, _BLOCK, r'\$?@\$?"(?:[^"]|"")*"?', _DOUBLE, _SINGLE), "php": (r"#[^\n]*", *_C), "c": _C,
}
QUIET |= {"tsx": QUIET["typescript"], "javascript": QUIET["typescript"], "kotlin": QUIET["java"], "swift": QUIET["java"], "dart": QUIET["java"], "cpp": QUIET["c"]}
_MODS = r"(?P<mods>(?:(?:export|default|declare|abstract|async|public|private|protected|internal|fileprivate|open|static|final|override|sealed|data|suspend|inline|virtual|readonly|unsafe|mutating|partial|extern|const)\b[ \t]+)*)"
_TYPES = r"(?P<kw>class|interface|struct|enum|record|trait|protocol|object|mixin|extension|namespace)"
_HEAD, _NAME = r"(?:^|(?<=[{};]))[ \t]*", r"(?P<name>[A-Za-z_$][\w$]*)"
#: Declarations led by a keyword, at the beginning of a line of blanked text.
LED = {
    "rust": _HEAD + r"(?P<mods>pub(?:\([^)\n]*\))?[ \t]+)?(?:(?:async|unsafe|const|default|extern)[ \t]+)*(?P<kw>fn|struct|enum|trait|type|mod|const|static)[ \t]+(?:mut[ \t]+)?" + _NAME,
    "typescript": _HEAD + _MODS + r"(?P<kw>function\*?|class|interface|type|enum|namespace|(?:const|let|var)(?=[^\n=]*=[ \t]*class\b))[ \t]+" + _NAME,
    "go": r"^(?P<mods>)(?P<kw>func[ \t]*\([^)\n]*\)|func|type|const|var)[ \t]*" + _NAME,
    "kotlin": _HEAD + _MODS + r"(?P<kw>fun|class|interface|object)[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w<>?]+\.)?" + _NAME,
    "swift": _HEAD + _MODS + r"(?P<kw>func|class|struct|enum|protocol|extension)[ \t]+" + _NAME,
    "php": _HEAD + _MODS + r"(?P<kw>function|class|interface|trait)[ \t]+&?" + _NAME,
    "java": _HEAD + _MODS + _TYPES + r"[ \t]+" + _NAME,
    "c": r"^(?P<mods>(?:static[ \t]+|inline[ \t]+|typedef[ \t]+)*)(?P<kw>struct|class|enum|namespace)[ \t]+" + _NAME,
}
LED |= {"tsx": LED["typescript"], "javascript": LED["typescript"], "csharp": LED["java"], "dart": LED["java"], "cpp": LED["c"]}
#: Functions without a keyword, a name before brackets: within a class (all of these languages), or anywhere after a type (those of TYPED).
_BARE = _HEAD + _MODS + r"(?P<kw>(?:get|set)[ \t]+|\*[ \t]*)?" + _NAME + r"[ \t]*(?:<[^>\n]*>)?[ \t]*\("
_TYPED = _HEAD + _MODS + r"(?P<kw>(?:[\w$<>\[\],.?:&]+[ \t*&]+)+)(?:\w+::)?" + _NAME + r"[ \t]*\("
BARE = {"typescript": (_BARE,), "tsx": (_BARE,), "javascript": (_BARE,), "java": (_TYPED, _BARE), "csharp": (_TYPED, _BARE), "dart": (_TYPED, _BARE), "c": (_TYPED,), "cpp": (_TYPED, _BARE)}
TYPED = ("c", "cpp", "dart")
KIND = {"fn": "function", "function": "function", "function*": "function", "func": "function", "fun": "function", "trait": "trait", "interface": "interface", "type": "type", "mod": "module", "namespace": "module", "const": "constant", "static": "constant", "var": "constant"}
HOLDS = ("class", "interface", "trait")
#: How comments begin that document what follows.
DOCS = {"rust": ("///", "/**"), "csharp": ("///", "/**"), "swift": ("///", "/**"), "dart": ("///", "/**"), "go": ("//", "/*"), "c": ("//", "/*"), "cpp": ("//", "/*"), "python": ("#",)}
CALL = re.compile(r"(?<![\w$])(?:(?P<prefix>[A-Za-z_$][\w$]*+)(?:\([^()\n]*\))?\s*(?P<by>\?\.|\.|::|->)\s*)?(?<![\w$])(?P<name>[A-Za-z_$][\w$]*+)(?:::<[^>\n]*>)?[ \t]*\(")
NOT_CALLED = frozenset(KEYWORDS) | frozenset("new await async else do try with lambda yield assert is as impl where throw using foreach import type var const typeof delete void".split())
#: Words of single languages.
ALSO_NOT_CALLED = {"go": {"go", "select", "range", "defer", "interface", "struct"}, "php": {"echo", "isset", "empty", "list", "array"}, "csharp": {"lock", "fixed", "nameof"}, "swift": {"guard"}, "python": {"del"}, "java": {"synchronized"}}


def quiet_spans(content: str, language: str) -> list[tuple[int, int]]:
    """Where comments and strings stand; block comments of rust nest."""
    pattern, spans, at = re.compile("|".join(f"(?:{p})" for p in QUIET[language]), re.DOTALL), [], 0
    while m := pattern.search(content, at):
        end = m.end()
        if language == "rust" and m[0] == "/*":
            depth = 1
            for x in re.compile(r"/\*|\*/").finditer(content, end):
                depth += 1 if x[0] == "/*" else -1
                end = x.end()
                if not depth:
                    break
            end = len(content) if depth else end
        spans.append((m.start(), end))
        at = max(end, m.start() + 1)
    return spans


def blanked(content: str, spans: list[tuple[int, int]]) -> str:
    """The text with spaces for what is quiet, lines and places kept."""
    out, at = [], 0
    for a, b in spans:
        out += [content[at:a], re.sub(r"[^\n]", " ", content[a:b])]
        at = b
    return "".join([*out, content[at:]])


def _braced(code: str, language: str) -> list[dict]:
    """Declarations of a language of braces, with the classes that they stand in."""
    led, bare = re.compile(LED[language], re.MULTILINE), [re.compile(p, re.MULTILINE) for p in BARE.get(language, ())]
    found: list[dict] = []
    stack: list[dict] = [{"open": "", "start": 0, "chain": (), "inside": "top", "own": None}]

    def declared(a: int, b: int, frame: dict, body: bool) -> dict | None:
        """Note what is declared in code[a:b]; return the last one if a body follows it."""
        marks = list(led.finditer(code, a, b))
        ways = bare if frame["inside"] == "class" else bare[:1] if body and language in TYPED and frame["inside"] in ("top", "module") else []
        if not (marks and "(" not in code[a : marks[-1].start()]) and (body or "=" not in code[a:b]):
            marks += [m for m in (next(filter(None, (_last(p, a, b) for p in ways)), None),) if m and m["name"] not in NOT_CALLED and not re.search(r"\b(?:return|new|else|case)\b", m["kw"] or "")]
        for k, m in enumerate(marks):
            last = body and k == len(marks) - 1
            word = (m["kw"] or "").split("(")[0].strip()
            kind = KIND.get(word, "class") if m.re is led else "function"
            if kind == "type" and language == "go" and (said := re.compile(r"[ \t]+(struct|interface)\b").match(code, m.end())):
                kind = "class" if said[1] == "struct" else "interface"
            if kind == "constant" and language in ("typescript", "tsx", "javascript"):
                kind = "class"
            if language == "rust" and word == "fn" and not last:  # a signature of a trait
                continue
            if kind == "function" and (frame["chain"] or word == "func" and "(" in m["kw"]):
                kind = "method"
            stop = b if last else min(b, (code.find("\n", m.end()) + 1 or len(code) + 1) - 1) if not code[m.end() : b].count("\n") == 0 else b
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append({"kind": kind, "name": m["name"], "at": m.start("name"), "qualified": "::".join((*frame["chain"], m["name"])), "mods": m["mods"] or "", "start": begin, "head": stop, "end": stop})
        return found[-1] if body and marks else None

    def _last(p: re.Pattern, a: int, b: int) -> re.Match | None:
        return max(p.finditer(code, a, b), key=lambda m: m.start(), default=None)

    for x in re.finditer(r"[(){}\[\];]", code):
        top, i = stack[-1], x.start()
        if x[0] in "([":
            stack.append({**top, "open": x[0], "start": i + 1, "own": None})
        elif x[0] == "{":
            frame = {"open": "{", "start": i + 1, "chain": top["chain"], "inside": "block", "own": None}
            impl = re.search(r"(?m)^[ \t]*(?:unsafe[ \t]+)?impl\b(?:[ \t]*<[^{]*?>(?=[ \t]))?(?P<of>[^{]*)\Z", code[top["start"] : i]) if language == "rust" else None
            if impl:
                name = re.split(r"\bfor\b", impl["of"])[-1].split("where")[0].split("<")[0].strip()
                frame |= {"chain": (name,), "inside": "class"}
            elif own := declared(top["start"], i, top, True):
                frame |= {"own": own}
                if language != "rust" and own["kind"] in HOLDS:
                    frame |= {"chain": (*top["chain"], own["name"]) if language != "go" else (), "inside": "class"}
                elif own["kind"] == "module" or language == "rust" and own["kind"] in HOLDS:
                    frame |= {"inside": "module"}
                else:
                    frame |= {"chain": ()} if language == "rust" else {}
            stack.append(frame)
        elif x[0] == ";":
            if top["open"] in ("", "{"):
                declared(top["start"], i, top, False)
                top["start"] = i + 1
        else:
            opener = {")": "(", "]": "[", "}": "{"}[x[0]]
            while x[0] == "}" and len(stack) > 1 and stack[-1]["open"] != "{":  # an unclosed bracket ends with its block
                stack.pop()
            if len(stack) > 1 and stack[-1]["open"] == opener:
                frame = stack.pop()
                if x[0] == "}":
                    declared(frame["start"], i, frame, False)
                    if frame["own"]:
                        frame["own"]["end"] = i + 1
                    stack[-1]["start"] = i + 1
    if stack[-1]["open"] in ("", "{"):
        declared(stack[-1]["start"], len(code), stack[-1], False)
    for frame in stack:  # bodies that never end reach to the end of the file
        if frame["own"]:
            frame["own"]["end"] = len(code)
    return sorted(found, key=lambda d: d["start"])


def _indented(code: str) -> list[dict]:
    """Declarations of python: a body reaches to the next line that stands no further in."""
    found, open_ = [], []
    lines = [(m.start(), len(m[1].expandtabs())) for m in re.finditer(r"(?m)^([ \t]*)(?=\S)", code)]
    marks = {m.start(): m for m in re.finditer(r"(?m)^[ \t]*(?:async[ \t]+)?(?P<kw>def|class)[ \t]+(?P<name>\w+)", code)}
    deep, last = 0, 0
    for start, indent in lines:
        if deep == 0:
            while open_ and indent <= open_[-1][0]:
                open_.pop()[1]["end"] = last
        if deep == 0 and (m := marks.get(start)):
            classes = [d["name"] for _, d in open_ if d["kind"] == "class"]
            kind = "class" if m["kw"] == "class" else "method" if classes else "function"
            head, nested = m.end(), 0
            while head < len(code) and (nested or code[head] not in ":\n"):  # to the colon outside of brackets
                nested += (code[head] in "([{") - (code[head] in ")]}")
                head += 1
            d = {"kind": kind, "name": m["name"], "at": m.start("name"), "qualified": "::".join((*classes, m["name"])), "mods": "", "start": start + len(m[0]) - len(m[0].lstrip()), "head": head, "end": len(code)}
            found.append(d)
            open_.append((indent, d))
        line = code[start : (code.find("\n", start) + 1 or len(code) + 1) - 1]
        deep = max(0, deep + sum(map(line.count, "([{")) - sum(map(line.count, ")]}")))
        last = start + len(line.rstrip())
    for _, d in open_:
        d["end"] = last
    return found


def _doc(content: str, language: str, d: dict, spans: list[tuple[int, int]], starts: list[int]) -> str | None:
    """The docstring of a python declaration, else the comments right above."""
    if language == "python":
        k = bisect_left(starts, d["head"])
        if k < len(spans) and content[spans[k][0]] in "\"'" and not content[d["head"] : spans[k][0]].strip(": \t\r\n"):
            return " ".join(content[slice(*spans[k])].strip("\"'").split()) or None
    k, upper, lines, marks = bisect_left(starts, d["start"]) - 1, d["start"], [], DOCS.get(language, ("/**",))
    while k >= 0 and content.startswith(marks, spans[k][0]) and re.fullmatch(r"[ \t]*\r?\n?[ \t]*", content[spans[k][1] : upper]):
        lines.append(content[slice(*spans[k])])
        upper, k = spans[k][0], k - 1
    said = re.sub(r"(?m)^[ \t]*(?://[/!]?|#|/\*+|\*+(?!/))[ \t]?|[ \t]*\*+/[ \t]*$", "", "\n".join(reversed(lines)))
    return " ".join(said.split()) or None


def analysed(language: str, content: str) -> list[tuple]:
    """Rows of SYMBOLS for a text: its declarations, then its calls, each with the function around it."""
    spans = quiet_spans(content, language)
    code = blanked(content, spans)
    found = _indented(code) if language == "python" else _braced(code, language)
    starts = [a for a, _ in spans]
    raw = None if content.isascii() else content
    known, at, size = {}, 0, 0
    for p in sorted({p for d in found for p in (d["start"], d["end"])}):  # places in bytes, one pass
        size += p - at if raw is None else len(raw[at:p].encode())
        known[p], at = size, p
    rows, names = [], {d["at"] for d in found}
    for d in found:
        d["hash"] = hashlib.sha256(content[d["start"] : d["end"]].encode()).hexdigest()
        signature = " ".join(content[d["start"] : d["head"]].split()).rstrip(" {:=")
        rows.append(("symbol", d["kind"], d["name"], d["qualified"], d["mods"], known[d["start"]], known[d["end"]], d["hash"], signature, _doc(content, language, d, spans, starts), None, None, None, None))
    around, open_, passed = iter(found), [], NOT_CALLED | ALSO_NOT_CALLED.get(language, frozenset())
    ahead = next(around, None)
    for m in CALL.finditer(code):
        i = m.start("name")
        while ahead and ahead["start"] <= i:
            while open_ and open_[-1]["end"] <= ahead["start"]:
                open_.pop()
            open_.append(ahead)
            ahead = next(around, None)
        while open_ and open_[-1]["end"] <= i:
            open_.pop()
        if m["name"] in passed or i in names or re.search(r"\b(?:new|fn|def|func|fun|function)[ \t]+\Z", code[max(0, i - 12) : i]):
            continue
        holders = [d for d in open_ if d["end"] > i]
        if holders and holders[-1]["kind"] in ("interface", "trait"):  # a signature
            continue
        inner = next((d for d in reversed(holders) if d["kind"] in ("function", "method")), None)
        rows.append(("call", None, m["name"], None, None, None, None, None, None, None, m["prefix"], m["by"] is not None, inner and inner["qualified"], inner and inner["hash"]))
    return rows


_FIELDS = "what kind name qualified_name modifiers start_byte end_byte body_hash signature doc prefix is_method caller caller_hash".split()
SYMBOLS = T.StructType([T.StructField(f, T.LongType() if f.endswith("_byte") else T.BooleanType() if f == "is_method" else T.StringType()) for f in _FIELDS])


class _Analyse:
    def eval(self, language: str, content: str):
        yield from analysed(language, content or "")


def parsed(files: DataFrame) -> DataFrame:
    """Rows (path, language, SYMBOLS) of files (path, content) of known languages, by a table function that reads one file at a time.

    What stands in comments and strings declares and calls nothing.  Malformed sources give what can be read: a
    bracket that never closes ends with its block, a body that never ends reaches to the end of the file.
    Files without content give no rows.
    """
    known = files.select("path", "content", text.language_of(F.col("path")).alias("language")).where(F.col("language").isin(*QUIET) & F.col("content").isNotNull())
    table = F.udtf(_Analyse, returnType=SYMBOLS)
    return known.lateralJoin(table(F.col("language").outer(), F.col("content").outer())).drop("content")


def symbols(rows: DataFrame) -> DataFrame:
    """path, language, kind, name, qualified_name, visibility, start_byte, end_byte, body_hash, signature, doc of ``parsed`` rows."""
    return rows.where("what = 'symbol'").select("path", "language", "kind", "name", "qualified_name", visibility(F.col("language"), F.col("modifiers"), F.col("name")).alias("visibility"), "start_byte", "end_byte", "body_hash", "signature", "doc")


def calls(rows: DataFrame) -> DataFrame:
    """path, name, prefix, is_method, caller, caller_hash of each call of ``parsed`` rows; at the top of a file without a caller."""
    return rows.where("what = 'call'").select("path", "name", "prefix", "is_method", "caller", "caller_hash")


def fingerprints(found: DataFrame) -> DataFrame:
    """(file, element) for drift between revisions: what each file declares, with the hash of its body."""
    return found.select(F.col("path").alias("file"), F.concat_ws("@", "qualified_name", "body_hash").alias("element"))


def revisions(found: DataFrame) -> DataFrame:
    """path, qualified_name, first_seen, last_seen, n_bodies of symbols (path, qualified_name, body_hash, revision)."""
    return found.groupBy("path", "qualified_name").agg(F.min("revision").alias("first_seen"), F.max("revision").alias("last_seen"), F.count_distinct("body_hash").alias("n_bodies"))
