"""Merkle manifest, conversation repair and chat formatting against plain Python, with nulls, ties, repeats, long and empty inputs."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, merkle, repair

H = lambda s: hashlib.sha256(s.encode()).hexdigest()
DOC = "doc_id long, text string, lang string, source string, n_chars long, pos long, hash string, n int, grp string, root string"
CONV = "conv_id long, turn long, role string, text string, key string, copy int, audit string, kind int"


def _leaf(r, text):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def _path(levels, i):
    for nodes in levels[:-1]:
        run = i // 8 * 8
        yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])
        i //= 8


def _merkle(rows):
    by = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _tree([y[2] for y in sorted(by[x], key=lambda y: y[:3])]) for x in langs}
    top = _tree([trees[x][-1][0] for x in langs]) if langs else [[None]]
    for k, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(sorted(by[x], key=lambda y: y[:3])):
            path = [*_path(trees[x], i), *_path(top, k)]
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = _leaf(r, text)
            for left, right in path:
                node = H(left + node + right)
            yield r["doc_id"], leaf, trees[x][-1][0], top[-1][0], H("".join(a + b for a, b in path)), node, node == top[-1][0]


def _docs(n_of):
    rows = []
    for lang, n in n_of.items():
        rows += [{"doc_id": len(rows) * 7 % 5003, "text": f"Some Text {i} É" if i % 5 else None, "lang": lang, "source": "s" if i % 3 else None, "n_chars": i or None} for i in range(n)]
    return rows


@pytest.mark.parametrize(
    "n_of",
    [{"en": 1}, {"en": 9, "de": 1, None: 8}, {"en": 513, "fr": 512, "de": 65, "": 64}, {f"l{i}": 1 + i % 3 for i in range(70)}, {"en": 4097 + 600}],
    ids=["one", "few", "blocks", "many-languages", "two-rounds"],
)
def test_merkle(spark, monkeypatch, tmp_path, n_of):
    rows = _docs(n_of)
    rows += [dict(rows[0]), {**rows[0], "doc_id": None}, {**rows[0], "text": "other"}] if len(rows) > 1 else []
    spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], 1, "clash", 2, "clash", "clash") for r in rows], DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, _merkle(rows)))


def test_merkle_of_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []


# ---- repair


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out += [(turn, "user" if fate == 4 else role, text, c) for c in range({0: 0, 3: 2}.get(fate, 1))]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), H(r[2]), r[3]))


def _faults(rows):
    seen = set()
    for _, role, text, _ in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        yield "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))


GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def _cheapest(initials, faults):
    """Every sequence of edits with at most two inserted turns in a gap."""
    n, found = len(initials), []

    def grow(i, cost, audit, roles):
        for ins in range(3):
            for extra in itertools.product("ua", repeat=ins):
                now, letters = roles + "".join(extra), audit + "I" * ins
                if i == n:
                    if GRAMMAR.match(now):
                        found.append((cost + 2 * ins, letters))
                    continue
                if not re.match(r"s?(ua)*u?\Z", now):
                    continue
                grow(i + 1, cost + 2 * ins + 3, letters + "D", now)
                if faults[i] not in ("blank", "duplicate"):
                    cut = faults[i] == "truncated"
                    grow(i + 1, cost + 2 * ins + cut, letters + "K", now + (initials[i] or "?"))
                    for x in "ua":
                        grow(i + 1, cost + 2 * ins + 2 + cut, letters + "R", now + x)

    grow(0, 0, "", "")
    return min(found)


def _dp(initials, faults):
    """The same by strings from the end, for long conversations."""
    nxt, step = {0: 2, 1: 2, 2: 3, 3: 2}, {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, ""), 1: (4, "II"), 2: (2, "I"), 3: (0, "")}
    for x, fault in zip(reversed(initials), reversed(faults)):
        then, cut = {}, fault == "truncated"
        for s in range(4):
            ways = [(3 + best[s][0], "D" + best[s][1])]
            if fault not in ("blank", "duplicate"):
                ways.append((2 + cut + best[nxt[s]][0], "R" + best[nxt[s]][1]))
                if (s, x) in step:
                    ways.append((cut + best[step[s, x]][0], "K" + best[step[s, x]][1]))
            then[s] = min(ways)
        for _ in range(2):
            then = {s: min(then[s], (2 + then[nxt[s]][0], "I" + then[nxt[s]][1])) for s in range(4)}
        best = then
    return best[0]


def _repaired(rows, audit):
    out, k, user = [], 0, True
    for x in audit:
        role, text = ("", "") if x == "I" else rows[k][1:3]
        k += x != "I"
        if x == "D":
            continue
        if x == "K" and role[:1] == "s":
            out.append(f"{role}:{text}")
            continue
        out.append(f"{role if x == 'K' else 'user' if user else 'assistant'}:{text}")
        user = not user
    return H("\n".join(out))


def _repair(rows, cheapest):
    for conv in {r[0] for r in rows}:
        now = _damage([r for r in rows if r[0] == conv])
        faults, initials = list(_faults(now)), [r[1][:1] for r in now]
        cost, audit = cheapest(initials, faults)
        turns = [r[0] for r in now if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        yield conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, _repaired(now, audit)


def _convs(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "clash", 1, "clash", 2) for r in rows], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def _some(seed, n_convs, longest):
    draw = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None], ["Hi.", "cut off", "", " \n", None, "So? ", "é ü!", "same.", "a" * 5000 + "."]
    rows = []
    for conv in [None, -3, *range(n_convs)]:
        rows += [(conv, draw.choice([k, k, k, k + 3, None, 0]), draw.choice(roles), draw.choice(texts)) for k in range(draw.randint(1, longest))]
    return rows + rows[:3]


def test_repair_by_every_way(spark, tmp_path):
    rows = _some(1, 60, 3)
    got = sorted(map(str, map(tuple, repair.op12_repair(spark, _convs(spark, tmp_path, rows)).collect())))
    assert got == sorted(map(str, _repair(rows, _cheapest)))


def test_repair_of_long_conversations(spark, tmp_path):
    rows = _some(2, 30, 40) + [(999, k, ["user", "assistant", "tool"][k * k % 3], f"turn {k}" + "." * (k % 2)) for k in range(1500)]
    got = sorted(map(str, map(tuple, repair.op12_repair(spark, _convs(spark, tmp_path, rows)).collect())))
    assert got == sorted(map(str, _repair(rows, _dp)))


def test_repair_where_all_rows_are_dropped(spark, tmp_path):
    turn = next(k for k in range(1000) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    got = repair.op12_repair(spark, _convs(spark, tmp_path, [(5, turn, "user", "Hi.")])).collect()
    assert [tuple(r) for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", H(""))]
    assert repair.repair(spark.createDataFrame([], CONV)).collect() == []


def test_segments_join_to_the_whole():
    draw = random.Random(3)
    for n in (1, 63, 64, 65, 128, 700):
        rows = [(draw.choice("usat "), draw.random() < 0.2, draw.random() < 0.3) for _ in range(n)]
        path = repair._Path()
        for r in rows:
            path.add(*r)
        assert path.result() == _dp([r[0] for r in rows], ["blank" if r[1] else "truncated" if r[2] else None for r in rows])


# ---- chat

TRICKY = ["", None, "plain", chat.PLANTED, "<", "[", "</s", "<\\", "[\\INST]", "<\\\\/s>", "<<SYS>>x<</SYS>>", "<<</SYS>>>", "[[/INST]]", "\\", "$1\\2", "é [INST]\n</s>", "<s></s><\\s>", "x" * 300_000 + "</s>"]


def test_escape_is_reversible_and_leaves_no_mark(spark):
    texts = [t for t in TRICKY if t is not None] + ["".join(x) for x in itertools.product(["<", "[", "\\", "/", "s>", "SYS>>", "INST]"], repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).select("t", "e", chat.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t
        assert not re.search(r"[<\[]/?(s>|SYS>>|INST\])", r.e)


def _chat(rows):
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        yield conv, len(turns), H("".join(f"{role}\n{t}\n" for _, role, t in turns)), len(loss), H(loss)


def test_chat_reads_back(spark, tmp_path):
    draw = random.Random(4)
    roles = ["user", "assistant", "system", "tool", None, "", "<<SYS>>", "assistant", "user"]
    rows = [(conv, draw.choice([k, k, None]), draw.choice(roles), draw.choice(TRICKY)) for conv in [None, *range(40)] for k in range(draw.randint(1, 9))]
    rows += rows[:4]
    sf = _convs(spark, tmp_path, rows)
    planted = [(-7, 0, "user", chat.PLANTED), (-7, 1, "assistant", chat.PLANTED)]
    got = chat.op13_chat(spark, sf).collect()
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(map(str, _chat(rows + planted)))
    examples = chat.chat_examples(spark.read.parquet(f"{sf}/conversations.parquet")).collect()
    for conv in {r[0] for r in rows}:
        mine = sorted((e for e in examples if e.conv_id == conv), key=lambda e: e.example)
        whole = mine[-1].formatted
        assert mine[-1].complete and not any(e.complete for e in mine[:-1])
        assert all(whole.startswith(e.formatted) and e.formatted.endswith("</s>") for e in mine)
        assert sum(e.loss_end > e.loss_start or e.formatted[: e.loss_start].endswith("[/INST]") for e in mine) == sum(r[0] == conv and r[2] == "assistant" for r in rows)


def test_chat_of_nothing(spark):
    assert chat.chat_digests(chat.chat_examples(spark.createDataFrame([], CONV))).collect() == []
