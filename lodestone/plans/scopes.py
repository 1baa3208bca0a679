"""Queries of parsed scopes, calls and body hashes over sources that a rule makes of conversations, with SQL that derives the answer from the same rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import similarity
from ..sources import lexer
from ..sources.views import Views
from .registry import query

#: By language: how a file's name ends, its head and foot, and the method of a turn with declarations and calls in comments and strings. C is
#: the conversation, T the turn, R the role, Q the text without quotes and marks; the method's body lies between the bars.
SHAPES = (
    (".py", "class K_C:\n", "", '    |def m_T(self):\n        # def fake(): call(Q)\n        s = "no(Q"\n        return self.R(T)|\n'),
    (".ts", "export class K_C {\n", "}\n", '  |m_T(x: number) {\n    // fake(1) { Q\n    const s = "no(Q" + `gone(Q`;\n    return R(x, T);\n  }|\n'),
    (".rs", "impl<T> K_C<T> {\n", "}\n", '    |pub fn m_T(&self) {\n        /* fn fake() { /* Q */ } */\n        let s = r#"no("Q"#;\n        R::run(T);\n    }|\n'),
)
QUOTES = r"[\\\\\"'`\n\r*/#|{}]"


def _filled(shape: str) -> Column:
    out = F.lit(shape)
    for mark, value in (("K_C", F.concat(F.lit("K_"), "conv_id")), ("m_T", F.concat(F.lit("m_"), "turn")), ("R(", F.concat("role", F.lit("("))), ("R::", F.concat("role", F.lit("::"))), ("(T)", F.concat(F.lit("("), "turn", F.lit(")"))), ("x, T", F.concat(F.lit("x, "), "turn")), ("Q", F.col("q"))):
        out = F.replace(out, F.lit(mark), value.cast("string"))
    return out


def _pick(i: int) -> Column:
    out = F.lit(None).cast("string")
    for k, s in enumerate(SHAPES):
        out = F.when(F.col("conv_id") % len(SHAPES) == k, _filled(s[i])).otherwise(out)
    return out


def sources_of(v: Views, edited: bool = False) -> DataFrame:
    """path, content: a class for each conversation and a method for each turn; in the edited revision, those of odd turns call otherwise."""
    role = F.when(F.lit(edited) & (F.col("turn") % 2 == 1), F.concat("role", F.lit("_new"))).otherwise(F.col("role"))
    t = v.table("conversations").select("conv_id", "turn", role.alias("role"), F.regexp_replace("text", QUOTES.replace("\\\\\\\\", "\\\\"), " ").alias("q"))
    units = t.select("conv_id", "turn", F.replace(_pick(3), F.lit("|"), F.lit("")).alias("unit"))
    files = units.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "unit"))), lambda x: x["unit"]), "").alias("units"))
    marks = files.withColumns({"turn": F.lit(0), "role": F.lit(""), "q": F.lit("")})
    return marks.select(F.concat(F.lit("src/c"), "conv_id", _pick(0)).alias("path"), F.concat(_pick(1), "units", _pick(2)).alias("content"))


def _sql_fill(shape: str, role: str = "role") -> str:
    out = "'" + shape.replace("'", "''") + "'"
    for mark, value in (("K_C", "'K_' || conv_id"), ("m_T", "'m_' || turn"), ("R(", f"{role} || '('"), ("R::", f"{role} || '::'"), ("(T)", "'(' || turn || ')'"), ("x, T", "'x, ' || turn"), ("Q", "q")):
        out = f"replace({out}, '{mark}', {value})"
    return out


def _sql_pick(i: int, role: str = "role") -> str:
    return "CASE conv_id % 3 " + " ".join(f"WHEN {k} THEN {_sql_fill(s[i], role)}" for k, s in enumerate(SHAPES)) + " END"


def _sql(role: str = "role", tag: str = "") -> str:
    return rf"""t{tag} AS (SELECT conv_id, turn, {role} AS role, regexp_replace(text, '[\\"''`\n\r*/#|{{}}]', ' ', 'g') AS q FROM conversations),
u{tag} AS (SELECT conv_id, turn, role, q, {_sql_pick(3)} AS unit FROM t{tag}),
f{tag} AS (SELECT conv_id, 'src/c' || conv_id || CASE conv_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' ELSE '.rs' END AS path, string_agg(replace(unit, '|', ''), '' ORDER BY turn) AS units FROM u{tag} GROUP BY conv_id),
m{tag} AS (SELECT path, 'method' AS kind, 'K_' || conv_id || '::m_' || turn AS qualified_name, CASE conv_id % 3 WHEN 1 THEN 'private' ELSE 'public' END AS visibility, split_part(unit, '|', 2) AS body,
  CASE conv_id % 3 WHEN 0 THEN 'def m_' || turn || '(self)' WHEN 1 THEN 'm_' || turn || '(x: number)' ELSE 'pub fn m_' || turn || '(&self)' END AS signature FROM u{tag} JOIN f{tag} USING (conv_id)
  UNION ALL SELECT path, 'class', 'K_' || conv_id, 'public', CASE conv_id % 3 WHEN 0 THEN rtrim('class K_' || conv_id || ':' || chr(10) || units, chr(10)) ELSE 'export class K_' || conv_id || ' {{' || chr(10) || units || '}}' END,
  CASE conv_id % 3 WHEN 0 THEN 'class K_' || conv_id ELSE 'export class K_' || conv_id END FROM f{tag} WHERE conv_id % 3 < 2)"""


@query(f"WITH {_sql()} SELECT path, kind, qualified_name, visibility, signature, octet_length(encode(body))::BIGINT AS n_bytes, sha256(body) AS body_hash FROM m")
def parsed_symbols(v: Views) -> DataFrame:
    found = lexer.symbols(lexer.parsed(sources_of(v)))
    return found.select("path", "kind", "qualified_name", "visibility", "signature", (F.col("end_byte") - F.col("start_byte")).alias("n_bytes"), "body_hash")


@query(f"""WITH {_sql()} SELECT path, CASE conv_id % 3 WHEN 2 THEN 'run' ELSE role END AS name, CASE conv_id % 3 WHEN 0 THEN 'self' WHEN 2 THEN role END AS prefix, conv_id % 3 <> 1 AS is_method,
'K_' || conv_id || '::m_' || turn AS caller, sha256(split_part(unit, '|', 2)) AS caller_hash FROM u JOIN f USING (conv_id)""")
def parsed_calls(v: Views) -> DataFrame:
    return lexer.calls(lexer.parsed(sources_of(v)))


@query(f"""WITH {_sql()}, {_sql("CASE WHEN turn % 2 = 1 THEN role || '_new' ELSE role END", "2")}, a AS (SELECT DISTINCT path, qualified_name || '@' || sha256(body) AS e FROM m), b AS (SELECT DISTINCT path, qualified_name || '@' || sha256(body) AS e FROM m2),
n AS (SELECT path, count(*) AS n FROM a GROUP BY path), n2 AS (SELECT path, count(*) AS n FROM b GROUP BY path), c AS (SELECT a.path, count(*) AS n FROM a JOIN b USING (path, e) GROUP BY a.path)
SELECT path AS file, round(1 - coalesce(c.n, 0) / (n.n + n2.n - coalesce(c.n, 0)), 6) AS score FROM n JOIN n2 USING (path) LEFT JOIN c USING (path) WHERE coalesce(c.n, 0) < greatest(n.n, n2.n)""")
def parsed_drift(v: Views) -> DataFrame:
    """Drift of each file between two revisions by the hashes of what it declares."""
    before, after = (lexer.fingerprints(lexer.symbols(lexer.parsed(sources_of(v, edited)))) for edited in (False, True))
    return similarity.drift(before, after).select("file", F.round("score", 6).alias("score"))


@query(f"""WITH {_sql()}, {_sql("CASE WHEN turn % 2 = 1 THEN role || '_new' ELSE role END", "2")}, a AS (SELECT path, qualified_name, sha256(body) AS h, 1 AS r FROM m UNION ALL SELECT path, qualified_name, sha256(body), 2 FROM m2)
SELECT path, qualified_name, min(r)::INT AS first_seen, max(r)::INT AS last_seen, count(DISTINCT h) AS n_bodies FROM a GROUP BY ALL""")
def parsed_revisions(v: Views) -> DataFrame:
    both = [lexer.symbols(lexer.parsed(sources_of(v, edited))).withColumn("revision", F.lit(1 + edited)) for edited in (False, True)]
    return lexer.revisions(both[0].unionByName(both[1]))
