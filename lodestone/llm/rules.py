"""Quality rules: text statistics and a decision list learned by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, let, read, text_of, words_of

SYMBOLS = "#*$%&|<>"
#: The ratios that conditions of a rule test.
FEATURES = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "shout_ratio", "pipe_ratio", "digit_ratio", "distinct_ratio", "words_per_line", "log_words")


def repeat_words(words: Column) -> Column:
    """Words in 3-word windows that occur twice or more among ``words``, first ones included.

    Each window is one number, the upper bits of its 64-bit hash above the bits of its
    position, so that sorting numbers makes equal windows neighbours; neighbours are then
    held against each other by the whole hash.  Where neighbours share the upper bits alone, an
    unlike window may stand between two equal ones, and the text's windows are sorted again as
    pairs of whole hash and position.  Texts whose windows all differ stop before.  Windows of one
    hash (two unlike ones of a text of n words: n * n / 2**65) count as equal.
    """

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def in_pairs(h: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"])),
        )

    def twice(h: Column) -> Column:
        room = F.element_at(F.array(*[F.lit((1 << b) - 1).cast("long") for b in (10, 13, 16, 20, 31)]), F.when(F.size(h) < 1 << 10, 1).when(F.size(h) < 1 << 13, 2).when(F.size(h) < 1 << 16, 3).when(F.size(h) < 1 << 20, 4).otherwise(5))

        def found(mask: Column) -> Column:
            def pick(s: Column) -> Column:
                at = lambda x: x.bitwiseAND(mask).cast("int")
                near = lambda x, y: (x.bitwiseXOR(y) <= mask) & (x.bitwiseXOR(y) >= 0)
                whole = lambda x: F.get(h, at(x))
                same = lambda x, y: F.coalesce(near(x, y) & (whole(x) == whole(y)), F.lit(False))
                mixed = F.exists(F.transform(s, lambda x, j: F.coalesce(near(x, F.get(s, j - 1)) & (whole(x) != whole(F.get(s, j - 1))), F.lit(False))), lambda x: x)
                return F.when(mixed, in_pairs(h)).otherwise(F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), at)))

            return let(F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long")))), pick)

        return let(room, found)

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, start, lambda a, x: F.struct((x + 3).alias("end"), (a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n")), lambda a: a["n"])

    none = F.lit(0).cast("long")
    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(twice(h), covered)).otherwise(none)
    return F.when(F.size(words) >= 3, let(windows(words), some)).otherwise(none)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and FEATURES of each row, in one pass without shuffle."""
    t = F.col("t")
    left = lambda s, keep: F.length(F.regexp_replace(s, f"[^{keep}]+", "")).cast("long")
    signs = lambda s: F.struct(left(s, SYMBOLS).alias("symbols"), left(s, "A-Z").alias("upper"), left(s, "!?").alias("shout"), left(s, "|").alias("pipes"), left(s, "0-9").alias("digits"))
    counted = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select(
        "doc_id",
        let(F.regexp_replace(t, f"[^A-Z0-9!?{SYMBOLS}]+", ""), signs).alias("signs"),
        let(
            F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")),
        ).alias("lines"),
        let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("all"),
                F.length(F.array_join(w, "")).cast("long").alias("chars"),
                F.size(F.array_distinct(w)).cast("long").alias("distinct"),
                repeat_words(w).alias("repeat"),
            ),
        ).alias("words"),
    )
    n, chars, lines = F.greatest(F.col("words.all"), F.lit(1)), F.greatest("words.chars", F.lit(1)), F.greatest(F.col("lines.all"), F.lit(1))
    return counted.select(
        "doc_id",
        F.col("words.all").alias("n_words"),
        F.col("words.chars").alias("word_chars"),
        F.col("signs.symbols").alias("n_symbols"),
        F.col("lines.dup").alias("n_dup_lines"),
        F.col("words.repeat").alias("n_repeat_words"),
        (F.col("words.chars") / n).alias("mean_word"),
        (F.col("signs.symbols") / n).alias("symbol_ratio"),
        (F.col("lines.dup") / lines).alias("dup_line_ratio"),
        (F.col("words.repeat") / n).alias("repeat_ratio"),
        (F.col("signs.upper") / chars).alias("upper_ratio"),
        (F.col("signs.shout") / n).alias("shout_ratio"),
        (F.col("signs.pipes") / n).alias("pipe_ratio"),
        (F.col("signs.digits") / chars).alias("digit_ratio"),
        (F.col("words.distinct") / n).alias("distinct_ratio"),
        (F.col("words.all") / lines).alias("words_per_line"),
        F.log1p(F.col("words.all").cast("double")).alias("log_words"),
    )


@dataclass
class Rule:
    """A conjunction of (feature, at_least, threshold); a row that meets all of it is rejected."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def expression(self) -> Column:
        out = F.lit(True)
        for name, at_least, threshold in self.conditions:
            out = out & ((F.col(name) >= threshold) if at_least else (F.col(name) < threshold))
        return out


def _gain(p: float, n: float, all_p: float, all_n: float) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(all_p / (all_p + all_n))) if p else 0.0


def learn_decision_list(rows: DataFrame, *, features: tuple[str, ...] = FEATURES, cuts: int = 32, max_rules: int = 10, max_conditions: int = 3, min_precision: float = 0.95, min_cover: int = 5) -> list[Rule]:
    """Sequential covering over ``rows`` (y 1 for rejected and 0 for kept, features, grow boolean).

    A rule grows by the condition of highest gain on the growing rows, taken from a histogram
    of features by quantile bin; it is cut back to the prefix that does best on the other rows,
    and stands if it is precise there.  What it covers goes, and the next rule is sought.  Only
    histograms (features x bins) and counts reach the driver.
    """
    if not (first := rows.agg(*[F.percentile_approx(f, [i / cuts for i in range(1, cuts)], 2000).alias(f) for f in features]).first()) or first[0] is None:
        return []
    edges = {f: sorted(set(first[f])) for f in features}
    bins = [sum([(F.col(f) >= e).cast("int") for e in edges[f]], F.lit(0)).alias(f"b_{f}") for f in features]
    left = durable(rows.select("y", "grow", *features, *bins), "rules-labelled")
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rule, inside = Rule(), left
        while len(rule.conditions) < max_conditions:
            cells = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features]))
            seen = inside.where("grow").select("y", cells.alias("c")).groupBy("c.f", "c.b").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
            table = {f: {r["b"]: (r["p"], r["n"] - r["p"]) for r in seen if r["f"] == f} for f in features}
            all_p, all_n = (sum(x[k] for x in table[features[0]].values()) for k in (0, 1))
            best = (1e-9, None)
            if not all_p or not all_n:
                break
            for f in features:
                for k, e in enumerate(edges[f], 1):
                    above = [sum(x[i] for b, x in table[f].items() if b >= k) for i in (0, 1)]
                    for at_least, (p, n) in ((True, above), (False, (all_p - above[0], all_n - above[1]))):
                        if p >= min_cover and (g := _gain(p, n, all_p, all_n)) > best[0]:
                            best = (g, (f, at_least, e))
            if best[1] is None:
                break
            rule.conditions.append(best[1])
            inside = left.where(rule.expression())
        if not rule.conditions:
            break
        tried = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
        counts = left.where("not grow").agg(*[F.count_if(r.expression() & (F.col("y") == v)).alias(f"{v}_{k}") for k, r in enumerate(tried) for v in (1, 0)]).first()
        worth = lambda k: (counts[f"1_{k}"] - counts[f"0_{k}"]) / (counts[f"1_{k}"] + counts[f"0_{k}"] + 1)
        k = max(range(len(tried)), key=lambda i: (worth(i), -i))
        p, n = counts[f"1_{k}"], counts[f"0_{k}"]
        if p < min_cover or p / (p + n) < min_precision:
            break
        rules.append(tried[k])
        left = left.where(~tried[k].expression())
    return rules


def decide(rules: list[Rule]) -> Column:
    """The number of the first rule that a row meets, from 1, as one conditional expression; null if none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        out = F.when(rules[k].expression(), F.lit(k + 1)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, **learning) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept of each row.

    ``labels`` has doc_id and quality (1 good, 0 bad).  The list is learned from labelled rows
    that pass the base rules; a third of them, by hash of the id, only prunes.

    Nulls: a null text has no words and fails the base rules; a null id has no label; null
    labels are left out, several of one id are averaged, ties counting as good.  Repeated rows
    get equal results.  Without labels of both kinds no rule is learned.  An empty table gives
    no rows.  Other columns aren't read.
    """
    stats = durable(text_statistics(docs, id_col, text_col), "rules-statistics")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("y"))
    rows = stats.where(~failed).join(marks, "doc_id").select("y", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow"), *FEATURES)
    rules = learn_decision_list(rows, **learning)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), decide(rules).alias("rule")).select("*", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def op9_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
