"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Shallow trees are grown on bootstrap samples of the labelled rows; every path from a root is a rule (a conjunction of
comparisons). A lasso logistic regression over the rules keeps a few with a weight, and these become one Spark column
expression, so that scoring is a scan without a shuffle and without Python. The statistics see the whole text only;
labels, language, source and id are never inputs.

The fit uses at most ``max_train`` labelled rows (those with the least hash of their id), a documented bound: they are
the only rows that reach the driver. Everything else covers all rows.

Defined cases: null text counts as empty; the statistics of an empty text are zeros, so it has a score like any other;
a null id is not held out; label rows with nulls are passed over and several labels of one id are averaged; without
labels of both kinds the score is the share of label 1 (0.5 without labels); an empty table gives an empty result;
further columns are kept by ``good`` and not read by ``scores``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_TRAIN = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Shares and means of a text; all are zero for an empty one."""
    n = F.length(text)
    words = F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    left = lambda drop: F.length(F.regexp_replace(text, drop, ""))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))

    return {
        "upper": share(left(r"[^\p{Lu}]+"), n),
        "digit": share(left(r"[^0-9]+"), n),
        "symbol": share(left(r"[\p{L}\p{M}0-9 \n.,;:'\"?()-]+"), n),
        "bang": share(left(r"[^!]+"), n),
        "bar": share(left(r"[^|]+"), n),
        "stop": share(left(r"[^.]+"), F.size(words)),
        "comma": share(left(r"[^,]+"), F.size(words)),
        "word_length": share(n, F.size(words)),
        "word_variety": share(F.size(F.array_distinct(words)), F.size(words)),
        "line_variety": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_length": share(F.size(words), F.size(lines)),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, at most?, bound) each; ``weight`` is its log odds."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float

    def column(self) -> Column:
        met = F.lit(True)
        for name, at_most, bound in self.tests:
            met = met & (F.col(name) <= F.lit(bound) if at_most else F.col(name) > F.lit(bound))
        return F.when(met, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self, docs: DataFrame, text: Column) -> DataFrame:
        """``docs`` with the columns of statistics, ``__at`` and ``score``.

        A filter that reads ``__at``, which depends on the place of a row, is not pushed below the statistics; pushed
        down, it would hold a copy of a statistic for every rule that uses it."""
        stats = docs.withColumns(statistics(F.coalesce(text, F.lit(""))) | {"__at": F.monotonically_increasing_id()})
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + rule.column()
        return stats.withColumn("score", 1 / (1 + F.exp(-total)))


def grow(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], rng: np.random.Generator, depth: int) -> list[tuple]:
    """The paths of one tree: tuples of (feature, at most?, bound); x holds the bin of each value among the cuts."""
    found: list[tuple] = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            found.append(path)
        if len(path) == depth or len(rows) < 20 or y[rows].min() == y[rows].max():
            return
        best, where = 1e-9, None
        total, ones = len(rows), y[rows].sum()
        for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
            if not len(cuts[f]):
                continue
            n = np.cumsum(np.bincount(x[rows, f], minlength=len(cuts[f]) + 1))[:-1]
            k = np.cumsum(np.bincount(x[rows, f], y[rows], len(cuts[f]) + 1))[:-1]
            m, j = total - n, ones - k
            ok = (n >= 5) & (m >= 5)
            gain = np.where(ok, k**2 / np.maximum(n, 1) + j**2 / np.maximum(m, 1) - ones**2 / total, 0)
            if gain.max() > best:
                best, where = gain.max(), (f, int(gain.argmax()))
        if where:
            f, c = where
            below = x[rows, f] <= c
            split(rows[below], (*path, (f, True, float(cuts[f][c]))))
            split(rows[~below], (*path, (f, False, float(cuts[f][c]))))

    split(rng.integers(0, len(y), len(y)), ())
    return found


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an absolute penalty on the weights, by accelerated proximal steps."""
    n, k = a.shape
    full = np.hstack([a, np.ones((n, 1))])
    rate = 4 * n / np.linalg.norm(full, 2) ** 2
    w = z = np.zeros(k + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(full @ z, -30, 30)))
        new = z - rate * (full.T @ (p - y)) / n
        new[:k] = np.sign(new[:k]) * np.maximum(np.abs(new[:k]) - rate * penalty, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        z, w = new + (before - 1) / t * (new - w), new
    return float(w[k]), w[:k]


def fit(values: np.ndarray, names: list[str], y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 10 or share in (0.0, 1.0):
        share = min(max(share, 0.01), 0.99)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(values[:, f], np.linspace(0.01, 0.99, 50))) for f in range(values.shape[1])]
    bins = np.stack([np.searchsorted(c, values[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    paths = sorted({tuple(sorted(p)) for _ in range(trees) for p in grow(bins, y, cuts, rng, depth)})

    def met(path: tuple) -> np.ndarray:
        return np.logical_and.reduce([values[:, f] <= b if low else values[:, f] > b for f, low, b in path])

    columns, kept, seen = [], [], set()
    for path in paths:
        column = met(path)
        if 0 < column.sum() < len(y) and (key := column.tobytes()) not in seen:
            seen.add(key)
            columns.append(column)
            kept.append(path)
    a = np.stack(columns, axis=1).astype(float)
    intercept, weights = lasso(a, y, penalty)
    rules = tuple(Rule(tuple((names[f], low, b) for f, low, b in p), float(w)) for p, w in zip(kept, weights, strict=True) if abs(w) > 1e-4)
    return RuleEnsemble(intercept, rules)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> RuleEnsemble:
    label = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    label = label.groupBy(F.col("doc_id").alias("__id")).agg((F.avg("quality") >= 0.5).cast("double").alias("__label"))
    label = label.orderBy(F.xxhash64("__id"), "__id").limit(max_train)  # at most max_train narrow rows: safe to broadcast
    texts = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(F.broadcast(label), "__id")
    stats = statistics(F.coalesce("__text", F.lit("")))
    rows = texts.select("__id", F.col("__label").alias("__y"), *(c.cast("double").alias(n) for n, c in stats.items()))
    rows = rows.orderBy(F.xxhash64("__id"), "__id", *stats).limit(max_train).toPandas()
    return fit(rows[list(stats)].to_numpy(float), list(stats), rows["__y"].to_numpy(float))


def scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    out = model.score(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("__text")), F.col("__text"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    plain = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("__row"), docs[text_col].alias("__text"))
    return model.score(plain, F.col("__text")).where("score >= 0.5 and __at >= 0").select("__row.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
