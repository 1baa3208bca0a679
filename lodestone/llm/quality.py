"""Quality classifier by co-training of a text-content view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, read, text_of
from .numbers import U64, hash_words, mix
from .rules import FEATURES, text_statistics

#: Metadata fields whose values each have a weight, and the most values of a field that are kept, the commonest of those trained on.
VALUES = {"source": 20000, "lang": 200}
#: Buckets that the words of a text are hashed into, and the scale of their shares.
BUCKETS, SCALE = 256, 256.0
#: Rows of the bounded training table that are taken at a time, so that the driver holds it once and no copies of it.
BLOCK = 2048


def content_of(texts: pa.Array) -> pa.Array:
    """BUCKETS bytes a text: the square root of the share of its words in each bucket, 255 at most."""
    out = []
    for lo in range(0, len(texts), 256):
        part = texts[lo : lo + 256]
        (h,), first = hash_words(part)
        row = np.repeat(np.arange(len(part)), np.diff(first))
        counts = np.bincount(row * BUCKETS + (mix(h) % U64(BUCKETS)).astype(np.int64), minlength=len(part) * BUCKETS).reshape(-1, BUCKETS)
        shares = np.sqrt(counts / np.maximum(np.diff(first), 1)[:, None])
        out += [x.tobytes() for x in np.minimum(np.rint(shares * 256), 255).astype(np.uint8)]
    return pa.array(out, pa.binary())


@dataclass
class View:
    """An additive model: a weight for each bin of each number, for each bucket of content and each value trained on, and the line that calibrates its logit; all other values weigh 0."""

    edges: dict[str, list[float]]
    weights: dict[str, list[float]]
    values: dict[str, dict[str, float]]
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    content: list[float] = field(default_factory=list)

    def weighed(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the weight of each value, from a broadcast table."""
        for f, w in self.values.items():
            table = rows.sparkSession.createDataFrame(list(w.items()), f"{f} string, weight_{f} double")
            rows = rows.join(F.broadcast(table), f, "left")
        return rows

    def logit(self) -> Column:
        out = F.lit(self.bias)
        for f, w in self.weights.items():
            at = sum([(F.col(f) >= e).cast("int") for e in self.edges[f]], F.lit(0))
            out = out + F.element_at(F.array(*map(F.lit, w)), at + 1)
        for f in self.values:
            out = out + F.coalesce(f"weight_{f}", F.lit(0.0))
        if self.content:
            w = np.array(self.content)
            weigh = F.arrow_udf(lambda x: pa.array(_shares(x.to_pylist()) @ w), "double")
            out = out + weigh("content")
        return out * self.slope + self.shift

    def logits(self, rows) -> np.ndarray:
        """The same of a pandas table, before calibration."""
        out = np.full(len(rows), self.bias)
        for f, w in self.weights.items():
            out += np.array(w)[np.searchsorted(np.array(self.edges[f]), rows[f].to_numpy(float), side="right")]
        for f, w in self.values.items():
            out += rows[f].map(w).fillna(0.0).to_numpy(float)
        if self.content:
            out += _shares(rows["content"]) @ np.array(self.content)
        return out


def _shares(content) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, content)), np.uint8).reshape(-1, BUCKETS).astype(np.float32) / np.float32(SCALE)


def _matrix(rows, edges: dict[str, list[float]], fields: dict[str, list[str]], content: bool) -> np.ndarray:
    """A column of ones, and one for each bin, each bucket of content and each value of ``fields``, in one table filled in place."""
    n, width = len(rows), 1 + sum(len(e) + 1 for e in edges.values()) + (BUCKETS if content else 0) + sum(map(len, fields.values()))
    out, at, each = np.zeros((n, width), np.float32), 1, np.arange(n)
    out[:, 0] = 1
    for f, e in edges.items():
        out[each, at + np.searchsorted(np.array(e), rows[f].to_numpy(float), side="right")] = 1
        at += len(e) + 1
    if content:
        for i in range(0, n, BLOCK):
            out[i : i + BLOCK, at : at + BUCKETS] = _shares(rows["content"].iloc[i : i + BLOCK])
        at += BUCKETS
    for f, known in fields.items():
        place = rows[f].map({v: i for i, v in enumerate(known)})
        met = place.notna().to_numpy()
        out[each[met], at + place[met].to_numpy(int)] = 1
        at += len(known)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, group: np.ndarray | None = None, sure: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights of ``x``, whose first column is ones, and those of the groups (numbered from 0), by Newton steps; ``sure`` weighs the rows.

    Each row is in one group at most (-1 is none), so the groups' part of the Hessian is diagonal and is eliminated.
    """
    sure = np.ones(len(y)) if sure is None else sure
    group = np.full(len(x), -1) if group is None else group
    n, width = int(group.max(initial=-1)) + 2, x.shape[1]  # the last group is none
    b, s, keep = np.zeros(width), np.zeros(n - 1), np.diag([1e-6] + [ridge] * (width - 1))
    for _ in range(30):
        g, gs, own, hessian, cross = -keep @ b, -ridge * np.append(s, 0), np.full(n, float(ridge)), keep.copy(), np.zeros((width, n))
        for i in range(0, len(x), BLOCK):
            rows, at = x[i : i + BLOCK], group[i : i + BLOCK] % n
            p = 1 / (1 + np.exp(-np.clip(rows @ b + np.append(s, 0)[at], -30, 30)))
            w, off = sure[i : i + BLOCK] * (p * (1 - p) + 1e-6), sure[i : i + BLOCK] * (y[i : i + BLOCK] - p)
            weighed = rows * w[:, None].astype(x.dtype)
            g += rows.T @ off
            hessian += (weighed.T @ rows).astype(float)
            gs += np.bincount(at, off, n)
            own += np.bincount(at, w, n)
            if n > 1:
                order = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.diff(at[order], prepend=-1))
                cross[:, at[order][first]] += np.add.reduceat(weighed[order], first, axis=0).T
        gs, own, cross = gs[:-1], own[:-1], cross[:, :-1]
        step = np.linalg.solve(hessian - (cross / own) @ cross.T, g - (cross / own) @ gs)
        move = (gs - cross.T @ step) / own
        b, s = b + step, s + move
        if max(np.abs(step).max(), np.abs(move).max(initial=0)) < 1e-3:
            break
    return b, s


def _with_ones(z: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(z)), z])


def _cut(values: np.ndarray, bins: int) -> list[float]:
    return sorted({float(v) for v in np.quantile(values, np.arange(1, bins) / bins)})


def _fit(rows, y: np.ndarray, edges: dict[str, list[float]], fields: tuple[str, ...], content: bool, sure: np.ndarray | None = None) -> View:
    """A view of ``rows``; sources, which may be many, are the groups of the fit."""
    kept = {f: list(rows[f].value_counts().sort_index().sort_values(ascending=False, kind="stable").index[: VALUES[f]]) for f in fields}
    at = {v: i for i, v in enumerate(kept.get("source", ()))}
    x = _matrix(rows, edges, {f: v for f, v in kept.items() if f != "source"}, content)
    b, s = _logistic(x, y, group=rows["source"].map(at).fillna(-1).to_numpy(int) if at else None, sure=sure)
    place, weights, values, words = 1, {}, {}, []
    for f, e in edges.items():
        weights[f] = [float(c) for c in b[place : place + len(e) + 1]]
        place += len(e) + 1
    if content:
        words = [float(c) for c in b[place : place + BUCKETS]]
        place += BUCKETS
    for f in fields:
        values[f] = dict(zip(kept[f], map(float, s if f == "source" else b[place : place + len(kept[f])])))
        place += 0 if f == "source" else len(kept[f])
    return View(edges, weights, values, float(b[0]), content=words)


def _last_taken(counts: DataFrame, by: str, wanted: dict[tuple, int]) -> dict[tuple, tuple]:
    """For each (view, mark) the value of ``by`` at which as many rows as ``wanted`` are met, from above, and how many stand before it; from counts (view, mark, by, n)."""
    upto = F.sum("n").over(Window.partitionBy("view", "mark").orderBy(F.desc(by)))
    reached = counts.select("view", "mark", by, "n", upto.alias("upto")).where(F.col("upto") - F.col("n") < _by_kind(wanted, 0))
    return {(r["view"], r["mark"]): (r["last"], r["n"]) for r in reached.groupBy("view", "mark").agg(F.min_by(F.struct(F.col(by).alias("last"), (F.col("upto") - F.col("n")).alias("n")), by).alias("b")).select("view", "mark", "b.*").collect()}


def _by_kind(of: dict[tuple, float], default: float) -> Column:
    out = F.lit(default)
    for (view, mark), value in of.items():
        out = F.when((F.col("view") == view) & (F.col("mark") == mark), F.lit(value)).otherwise(out)
    return out


def surest_of(pool: DataFrame, views: dict[str, View], lent: dict, share: float, per_round: int, least_sure: float = 0.9) -> dict:
    """For each view up to ``per_round`` rows of the whole ``pool`` that it is surest of and hasn't lent yet, with mark 1 or 0 in proportion of ``share``, as a bounded pandas table.

    Only rows whose calibrated chance of their mark is ``least_sure`` or more are lent, so a view that tells nothing lends nothing.
    They are taken by that chance to six places, equals by hash of the id; ``sure``, the distance from an even
    chance, is what they weigh.  Two histograms, of the chances and of the hashes at the last chance taken, give the exact bounds of the
    quota at any number of rows, and only rows within them meet.  All views are scored in one pass.  ``lent`` has the bounded tables of rows that each view has lent before.
    """
    rated, columns = pool.where("doc_id IS NOT NULL"), pool.columns
    for view in views.values():
        rated = view.weighed(rated)
    chances = F.array(*[F.struct(F.lit(v).alias("view"), _chance(view.logit()).alias("p")) for v, view in views.items()])
    rated = rated.select(*columns, F.explode(chances).alias("x")).select(*columns, "x.view", F.col("x.p").alias("p"))
    rated = rated.select(*columns, "view", (F.col("p") > 0.5).cast("int").alias("mark"), F.round(F.greatest("p", 1 - F.col("p")), 6).alias("chance"), F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("place")).where(F.col("chance") >= least_sure)
    known = [(v, x) for v, rows in lent.items() for x in rows["doc_id"].tolist()]
    if known:
        rated = rated.join(F.broadcast(rated.sparkSession.createDataFrame(known, rated.select("view", "doc_id").schema)), ["view", "doc_id"], "left_anti")
    quota = {(v, m): max(1, round(per_round * part)) for v in views for m, part in ((1, share), (0, 1 - share))}
    last = _last_taken(rated.groupBy("view", "mark", "chance").agg(F.count("*").alias("n")), "chance", quota)
    if not last:
        return {v: lent[v][:0] for v in views}
    bound = _by_kind({k: c for k, (c, _) in last.items()}, 2.0)
    part = F.shiftright("place", 4)
    parts = _last_taken(rated.where(F.col("chance") == bound).groupBy("view", "mark", part.alias("part")).agg(F.count("*").alias("n")), "part", {k: quota[k] - n for k, (_, n) in last.items()})
    within = rated.where((F.col("chance") > bound) | (F.col("chance") == bound) & (part >= _by_kind({k: c for k, (c, _) in parts.items()}, 0)))
    rank = F.row_number().over(Window.partitionBy("view", "mark").orderBy(F.desc("chance"), F.desc("place"), "doc_id"))
    top = within.select(*columns, "view", F.col("mark").cast("double").alias("mark"), (F.col("chance") * 2 - 1).alias("sure"), rank.alias("rank")).where(F.col("rank") <= max(quota.values()))
    found = top.where(F.col("rank") <= _by_kind({(v, m): q for (v, m), q in quota.items()}, 0)).drop("rank").toArrow().to_pandas()
    return {v: found[found["view"] == v].drop(columns="view").drop_duplicates("doc_id").reset_index(drop=True) for v in views}


def surest(pool: DataFrame, view: View, lent, share: float, per_round: int, least_sure: float = 0.9):
    """``surest_of`` a single view."""
    return surest_of(pool, {"view": view}, {"view": lent}, share, per_round, least_sure)["view"]


def co_train(labelled, pool: DataFrame, *, rounds: int = 3, per_round: int = 1000, least_sure: float = 0.9, bins: int = 10, log: list | None = None) -> tuple[View, View, tuple[float, float, float]]:
    """Both views and the weights (bias, text, metadata) that join their calibrated logits.

    A fifth of the labelled rows calibrates each view in each round and joins them in the end, the others train.  In each round each view
    scores the whole pool and labels the rows it is surest of among those it hasn't lent, for the other view to train on,
    as many of each kind as the labels' shares allow, each weighed by how sure it is.  ``log``, if given, gets (round, lender, rows lent).
    """
    import pandas as pd

    y = labelled["quality"].to_numpy(float)
    fit, hold = labelled["fold"].to_numpy() != 0, labelled["fold"].to_numpy() == 0
    if len(set(y[fit])) < 2 or len(set(y[hold])) < 2:
        fit = hold = np.ones(len(y), bool)
    numeric, fields = {"text": FEATURES, "meta": ()}, {"text": (), "meta": tuple(VALUES)}
    edges = {v: {f: _cut(labelled[f].to_numpy(float), bins) for f in fs} for v, fs in numeric.items()}
    lent = {v: labelled[:0].assign(mark=0.0, sure=0.0) for v in numeric}  # by each view
    held, share, views = labelled[hold], y[fit].mean(), {}
    for r in range(rounds + 1):
        for v, lender in (("text", "meta"), ("meta", "text")):
            got = lent[lender]
            rows = pd.concat([labelled[fit], got]) if len(got) else labelled[fit]
            marks = np.concatenate([y[fit], got["mark"].to_numpy(float)])
            view = views[v] = _fit(rows, marks, edges[v], fields[v], v == "text", np.concatenate([np.ones(int(fit.sum())), got["sure"].to_numpy(float)]))
            view.shift, view.slope = map(float, _logistic(_with_ones(view.logits(held)), y[hold], 0.01)[0])
        if r == rounds:
            break
        for v, new in surest_of(pool, views, lent, share, per_round, least_sure).items():
            if log is not None:
                log.append((r, v, len(new)))
            lent[v] = pd.concat([x for x in (lent[v], new) if len(x)] or [new])
    joined = [np.clip(view.logits(held) * view.slope + view.shift, -30, 30) for view in views.values()]
    both = _logistic(_with_ones(np.stack(joined, axis=1)), y[hold], 0.1)[0]
    return views["text"], views["meta"], tuple(float(b) for b in both)


def described(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the fields of both views, and what else is carried, in one pass without shuffle."""
    value = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    content = F.arrow_udf(content_of, "binary")
    given = docs.select(F.struct(F.col(id_col).alias("id"), value(source_col).alias("source"), value(lang_col).alias("lang"), content(text_of(text_col)).alias("content"), *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(carry)]).alias("key"), F.col(text_col).alias("text"))
    stats = text_statistics(given, "key", "text")
    return stats.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.source").alias("source"), F.col("doc_id.lang").alias("lang"), F.col("doc_id.content").alias("content"), *FEATURES, *[F.col(f"doc_id.keep_{i}").alias(f"keep_{i}") for i in range(len(carry))])


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``described`` rows with quality, 1 or 0, null where there is no label, as a table that training reads again and again."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    return durable(rows.join(known.hint("merge"), "doc_id", "left"), "quality-fields")


def train(rows: DataFrame, *, max_labelled: int = 20000, **training) -> tuple[View, View, tuple[float, float, float]] | None:
    """``co_train`` on rows ``with_labels``: at most ``max_labelled`` labelled ones, those of smallest id hash, and all others; None without labels of both kinds.

    Of rows that share an id the one of least content trains.  Only the labelled rows and those that a round picks come to the driver.
    """
    known, fields = rows.where("quality IS NOT NULL"), [c for c in rows.columns if c not in ("doc_id", "content")]
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    chosen = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("content", *fields)).alias("r")).select("doc_id", "r.*")
    labelled = chosen.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5))).toArrow().to_pandas().sort_values("doc_id")
    if labelled["quality"].nunique() < 2:
        return None
    return co_train(labelled, rows.where("quality IS NULL").drop("quality"), **training)


def _clip(z: Column) -> Column:
    return F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))


def _chance(z: Column) -> Column:
    return 1 / (1 + F.exp(-_clip(z)))


def scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` with the probability of good quality by text (p_text), by metadata (p_meta) and by both (score)."""
    if model is None:
        return rows.select("*", *[F.lit(0.5).alias(c) for c in ("p_text", "p_meta", "score")])
    text, meta, (bias, wt, wm) = model
    z = meta.weighed(text.weighed(rows)).select(*rows.columns, text.logit().alias("__text"), meta.logit().alias("__meta"))
    return z.select(*rows.columns, _chance(F.col("__text")).alias("p_text"), _chance(F.col("__meta")).alias("p_meta"), _chance(bias + wt * _clip(F.col("__text")) + wm * _clip(F.col("__meta"))).alias("score"))


def classify_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", **training) -> DataFrame:
    """doc_id, p_text, p_meta, score, keep of each row.

    Nulls: a null text is empty, null metadata are a value of their own, a null id has
    no label and isn't lent.  Labels of one id are averaged, ties counting as good.  Empty texts are scored
    like others.  Repeated rows score alike.  Without labels of both kinds all scores are 0.5
    and all rows are kept.  An empty table gives no rows.  Other columns aren't read.
    """
    rows = with_labels(described(docs, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col), labels)
    return scored(rows, train(rows, **training)).select("doc_id", "p_text", "p_meta", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **training) -> DataFrame:
    """The rows of ``docs`` (with the columns of documents, and any others) that ``classify_quality`` keeps, whole.

    Rows are described once and met again by id and text.  Nulls, ties, repeated rows, empty texts and tables as there; columns stay as
    they are, whatever their names.
    """
    text_hash = F.xxhash64(text_of("text"))
    keyed = docs.select("doc_id", "text", "source", "lang", text_hash.alias("__hash"))
    rows = with_labels(described(keyed, carry=("__hash",)), labels)
    good = scored(rows, train(rows, **training)).where(F.col("score") >= threshold).select(F.struct("doc_id", F.col("keep_0").alias("hash")).alias("__key"))
    held = docs.select(F.struct("doc_id", text_hash.alias("hash")).alias("__key"), *[F.col(c) for c in docs.columns])
    return held.join(good.hint("merge"), "__key", "left_semi").drop("__key")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return classify_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
