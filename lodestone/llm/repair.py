"""Conversation structure repair: cheapest edits by a DAG DP over scalar integers that carry cost and audit letters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read

BLANK = r"[^\x20\x09-\x0D]"

#: Digits of the audit letters, three bits each and in their ASCII order; 0 is the padding at the end.
BITS, LETTERS = 3, " DIKR"
D, I, K, R = 1, 2, 3, 4
#: Roles so far: nothing, a system turn, ends with user, ends with assistant; where an initial leads to, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
#: Costs of the edits, and of a truncated row that stays.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Rows of a segment; segments are joined in pairs of like size.
SEGMENT = 64

# ---- the DP. A weight is (value, letters): value = cost << width | letters from the highest digit down.


def _put(best: dict, state: int, value: int, n: int) -> bool:
    if state not in best or value < best[state][0]:
        best[state] = (value, n)
        return True
    return False


def _insert(best: dict, width: int) -> None:
    """Inserted turns before the next row; a third one would only return to a state at more cost."""
    for _ in range(2):
        for state, (value, n) in list(best.items()):
            _put(best, NEXT[state], value + (INSERT << width) + (I << width - BITS * (n + 1)), n + 1)


def _segment(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...]) -> dict:
    """size, width and best {(from, to): weight} of ``rows`` (initial, must go, truncated)."""
    width = BITS * (3 * len(rows) + 2)
    found = {}
    for start in starts:
        best = {start: (0, 0)}
        _insert(best, width)
        for initial, gone, cut in rows:
            then: dict = {}
            for state, (value, n) in best.items():
                at = width - BITS * (n + 1)
                _put(then, state, value + (DELETE << width) + (D << at), n + 1)
                if not gone:
                    stays = TRUNCATED << width if cut else 0
                    if (state, initial) in STEP:
                        _put(then, STEP[state, initial], value + stays + (K << at), n + 1)
                    _put(then, NEXT[state], value + stays + (REROLE << width) + (R << at), n + 1)
            best = then
            _insert(best, width)
        found |= {(start, end): x for end, x in best.items()}
    return {"size": len(rows), "width": width, "best": found}


def _join(a: dict, b: dict) -> dict:
    """Segment ``a`` followed by ``b``.

    Two ways of equal cost from one state to another through the same rows are never prefixes of
    each other (their row letters are as many, and what follows would be inserted turns, which
    cost), so the least weight of the whole is made of least weights of the parts.
    """
    wa, wb = a["width"], b["width"]
    width, best = wa + wb, {}
    for (start, mid), (x, n) in a["best"].items():
        for (m, end), (y, k) in b["best"].items():
            if m == mid:
                letters = ((x & (1 << wa) - 1) << wb) + ((y & (1 << wb) - 1) << wa - BITS * n)
                _put(best, (start, end), ((x >> wa) + (y >> wb) << width) + letters, n + k)
    return {"size": a["size"] + b["size"], "width": width, "best": best}


class _Path:
    """The rows of one conversation, handed over in order."""

    def __init__(self) -> None:
        self.rows: list = []
        self.done: list[dict] = []

    def add(self, initial: str, gone: bool, cut: bool) -> None:
        self.rows.append((initial, gone, cut))
        if len(self.rows) == SEGMENT:
            self._close()

    def _close(self) -> None:
        self.done.append(_segment(self.rows, tuple(range(4)) if self.done else (START,)))
        self.rows = []
        while len(self.done) > 1 and self.done[-2]["size"] <= self.done[-1]["size"]:
            b, a = self.done.pop(), self.done.pop()
            self.done.append(_join(a, b))

    def result(self) -> tuple[int, str]:
        """Cost and audit of the cheapest edits, of equal ones the least in ASCII."""
        if self.rows or not self.done:
            self._close()
        while len(self.done) > 1:
            b, a = self.done.pop(), self.done.pop()
            self.done.append(_join(a, b))
        whole = self.done[0]
        value, n = min(x for (_, end), x in whole["best"].items() if end in ENDS)
        letters = format(value & (1 << whole["width"]) - 1, "o").zfill(whole["width"] // BITS)[:n]
        return value >> whole["width"], letters.translate(str.maketrans("1234", LETTERS[1:]))


# ---- streams of rows sorted by conversation


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, cost and audit of each conversation of a partition sorted by conversation and place."""
    schema = pa.schema([("conv_id", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string())])
    out: list[tuple] = []
    now = path = n = least = most = last_turn = before = distinct = None

    def close() -> None:
        cost, audit = path.result()
        gaps = most - least + 1 - distinct if distinct else 0
        out.append((now[0], *[{**n, "gaps": gaps, "cost": cost}[c] for c in COUNTS], audit))

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        for conv, turn, dropped, initial, blank, duplicate, cut in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "dropped", "initial", "is_blank", "is_duplicate", "is_cut"))):
            if now is None or now[0] != conv:
                if now:
                    close()
                now, path, n = (conv,), _Path(), dict.fromkeys(COUNTS, 0)
                least = most = last_turn = before = None
                distinct = 0
            if dropped:
                continue
            if turn is not None:
                least, most = turn if least is None else least, turn
                distinct += turn != last_turn
                last_turn = turn
            if blank or duplicate or cut:
                n["blank" if blank else "duplicate" if duplicate else "truncated"] += 1
            if before is not None and before + initial not in ("su", "ua", "au"):
                n["illegal"] += 1
            before = initial
            path.add(initial, blank or duplicate, cut)
        if len(out) >= 1000:
            yield flush()
    if now:
        close()
    if out:
        yield flush()


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """repaired_sha256 of each conversation: its plan comes first in the partition, then its rows in order."""
    out: list[tuple] = []
    state: dict = {}

    def line(role: str, text: str) -> None:
        state["sha"].update((b"\n" if state["some"] else b"") + role.encode() + b":" + text.encode())
        state["some"] = True

    def inserts() -> None:
        """Turns inserted before the next row."""
        audit = state["audit"]
        while state["at"] < len(audit) and audit[state["at"]] == "I":
            line(state["role"], "")
            turn()
            state["at"] += 1

    def turn() -> None:
        state["role"] = "assistant" if state["role"] == "user" else "user"

    def close() -> None:
        if state:
            inserts()
            out.append((*state["plan"], state["sha"].hexdigest()))

    def flush() -> pa.RecordBatch:
        names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
        kinds = [pa.string(), *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(len(names))], names=names)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(c) for c in ("conv_id", "kind", "role", "text", "audit", *COUNTS)]
        for k in range(batch.num_rows):
            conv, kind, role, text, audit, *counts = (c[k].as_py() for c in columns)
            if kind == 0:
                close()
                state = {"plan": (conv, *counts, audit), "audit": audit, "at": 0, "role": "user", "sha": hashlib.sha256(), "some": False}
                continue
            inserts()
            letter = state["audit"][state["at"]]
            state["at"] += 1
            if letter == "K":
                line(role, text)
                if not role.startswith("s"):
                    turn()
            elif letter == "R":
                line(state["role"], text)
                turn()
        if len(out) >= 1000:
            yield flush()
    close()
    if out:
        yield flush()


# ---- the plan


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and dropped of each row after its damage; a dropped row stays as a mark of its conversation."""
    c = convs.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    fate = F.crc32(F.concat_ws(":", F.coalesce("conv_id", F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    c = c.withColumn("fate", fate)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return c.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (F.col("fate") == 0).alias("dropped"))


def _order(*before: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in (*before, "turn", "role", "key", "copy")]


def repair(convs: DataFrame) -> DataFrame:
    """conv_id (string), gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of each conversation of ``damaged``.

    Thin rows (flags and a digest of the text) are sorted by conversation first and yield counts
    and edits; then the edits meet the texts in a second sort, and the repaired turns go straight
    into the digest.  Both are streams: neither holds the texts of a conversation, however long;
    the weights of n turns take O(n) memory and are joined in pairs of segments, O(n log n).

    Nulls: a null role or text is one space, a null turn comes first and isn't counted in gaps, a
    null conv_id is a conversation of its own.  Empty texts are blank.  Rows of one turn are
    ordered by role, then by digest of the text; equal rows are duplicates.  A conversation all of
    whose rows are dropped has zeros, an empty audit and the digest of nothing.  An empty table
    gives no rows.  Other columns aren't read, whatever their names.
    """
    rows = damaged(convs).withColumn("key", F.sha2("text", 256))
    last = F.substring(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    is_blank = last == ""
    thin = rows.select("conv_id", "turn", "role", "key", "copy", "dropped", F.substring("role", 1, 1).alias("initial"), is_blank.alias("is_blank"), (~is_blank & ~last.isin(".", "!", "?")).alias("is_cut"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "key", "dropped").orderBy(F.col("turn").asc_nulls_first(), "copy")) > 1
    thin = thin.withColumn("is_duplicate", seen & ~F.col("is_blank") & ~F.col("dropped"))
    thin = thin.repartition("conv_id").sortWithinPartitions(*_order("conv_id"))
    plans = thin.mapInArrow(_plans, ", ".join(["conv_id string", *[f"{c} long" for c in COUNTS], "audit string"]))
    none = lambda kind: F.lit(None).cast(kind)
    plans = plans.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), none("string").alias("key"), F.lit(0).alias("copy"), "audit", *COUNTS)
    texts = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "key", "copy", none("string").alias("audit"), *[none("long").alias(c) for c in COUNTS])
    both = plans.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))
    return both.mapInArrow(_hashes, ", ".join(["conv_id string", *[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"]))


def op12_repair(spark, sf_dir: str) -> DataFrame:
    convs = read(spark, sf_dir, "conversations")
    return repair(convs).withColumn("conv_id", F.col("conv_id").cast(convs.schema["conv_id"].dataType))


#: crc32 of the ASCII text ``s`` in DuckDB, bit by bit.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s)::BIGINT + 1), lambda i: ascii(substr(s, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

OP12_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
fated AS (SELECT *, {CRC32_SQL} % 20 AS fate FROM c),
d AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
         CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fated WHERE fate <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, substr(role, 1, 1) AS initial,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM d),
p AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM o),
q AS (SELECT *, (NOT blank AND NOT again AND last NOT IN ('.', '!', '?'))::BIGINT AS cut, blank OR again AS gone FROM p),
n AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
         sum(cut)::BIGINT AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM q GROUP BY conv_id),
f AS (
  SELECT conv_id, n + 1 AS k, [{{'c': 0::BIGINT, 'a': ''}}, {{'c': 4::BIGINT, 'a': 'II'}}, {{'c': 2::BIGINT, 'a': 'I'}}, {{'c': 0::BIGINT, 'a': ''}}] AS v FROM n
  UNION ALL
  SELECT conv_id, k, list_transform([1, 2, 3, 4], lambda i: list_min([h[i], {{'c': 2 + h[nx[i]].c, 'a': 'I' || h[nx[i]].a}}]))
  FROM (
    SELECT conv_id, k, nx, list_transform([1, 2, 3, 4], lambda i: list_min([g[i], {{'c': 2 + g[nx[i]].c, 'a': 'I' || g[nx[i]].a}}])) AS h
    FROM (
      SELECT f.conv_id, q.k, [3, 3, 4, 3] AS nx, list_transform([1, 2, 3, 4], lambda i: list_min([{{'c': 3 + v[i].c, 'a': 'D' || v[i].a}}]
          || CASE WHEN gone THEN [] ELSE [{{'c': 2 + cut + v[[3, 3, 4, 3][i]].c, 'a': 'R' || v[[3, 3, 4, 3][i]].a}}] END
          || CASE WHEN gone THEN [] WHEN i = 1 AND initial = 's' THEN [{{'c': cut + v[2].c, 'a': 'K' || v[2].a}}] WHEN initial = ['u', 'u', 'a', 'u'][i] THEN [{{'c': cut + v[[3, 3, 4, 3][i]].c, 'a': 'K' || v[[3, 3, 4, 3][i]].a}}] ELSE [] END)) AS g
      FROM f JOIN q ON f.conv_id IS NOT DISTINCT FROM q.conv_id AND q.k = f.k - 1))),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM f WHERE k = 1),
e AS (SELECT conv_id, unnest(range(1, length(audit)::BIGINT + 1)) AS i, unnest(string_split(audit, '')) AS x FROM best WHERE audit <> ''),
e2 AS (SELECT *, sum((x <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS k FROM e),
e3 AS (SELECT e2.*, q.role, q.text, (x <> 'D' AND NOT (x = 'K' AND coalesce(q.initial, '') = 's'))::INT AS turns FROM e2 LEFT JOIN q ON e2.conv_id IS NOT DISTINCT FROM q.conv_id AND e2.k = q.k),
e4 AS (SELECT *, sum(turns) OVER (PARTITION BY conv_id ORDER BY i) - turns AS so_far FROM e3),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN so_far % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY i)) AS repaired_sha256
      FROM e4 WHERE x <> 'D' GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON a.conv_id IS NOT DISTINCT FROM n.conv_id
LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN r ON a.conv_id IS NOT DISTINCT FROM r.conv_id
"""
