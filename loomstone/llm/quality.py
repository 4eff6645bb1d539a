"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are Spark columns. Shallow trees are boosted on a bounded labelled sample; each path from
a root to a node becomes a conjunctive rule, an L1-penalised logistic regression weighs the rules, and
those of non-zero weight are compiled back into one Spark column.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, doc_key, rows_apart, table, words_of
from .toxicity import labelled_sample

#: Training reads at most this many labelled rows, those of least hash, and their whole texts.
SAMPLE_ROWS = 10_000
TREES, DEPTH, LEAF, CUTS = 24, 3, 12, 32
PENALTY, STEPS = 0.002, 600
THRESHOLD = 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ"
_DIGITS = "0123456789"
_MARKS = "#*$%&|<>{}[]=_~^\\/@+"
_STOPS = ".,;:!?"

#: name: the statistic, over the columns made by with_statistics().
STATISTICS: dict[str, Callable[[], Column]] = {
    "log_words": lambda: F.log1p(F.size("_words")),
    "word_length": lambda: _per(F.col("_solid"), F.size("_words")),
    "upper": lambda: _per(F.col("_solid") - _without(_UPPER), F.col("_solid")),
    "digits": lambda: _per(F.col("_solid") - _without(_DIGITS), F.col("_solid")),
    "marks": lambda: _per(F.col("_solid") - _without(_MARKS), F.col("_solid")),
    "bangs": lambda: _per(F.col("_solid") - _without("!"), F.col("_solid")),
    "bars": lambda: _per(F.col("_solid") - _without("|"), F.size("_words")),
    "stops": lambda: _per(F.col("_solid") - _without(_STOPS), F.size("_words")),
    "distinct_words": lambda: _per(F.size(F.array_distinct("_hashes")), F.size("_words")),
    "repeated_next": lambda: _per(
        F.size(F.filter(F.zip_with("_hashes", "_after", lambda a, b: a == b), lambda same: same)), F.size("_words")
    ),
    "distinct_lines": lambda: _per(F.size(F.array_distinct("_lines")), F.size("_lines")),
    "line_words": lambda: F.log1p(_per(F.size("_words"), F.size("_lines"))),
}


def _without(chars: str) -> Column:
    return F.length(F.translate("_dense", chars, ""))


def _per(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def with_statistics(rows: DataFrame) -> DataFrame:
    """`rows` with one double per statistic, read off the whole text (null: the empty one; nothing to count: 0)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    made = rows.withColumns({"_words": words_of(F.col("text")), "_dense": F.translate(text, SPACE_CHARS, ""), "_lines": F.split(text, "\n")})
    made = made.withColumns({"_hashes": F.transform("_words", lambda w: F.xxhash64(w)), "_solid": F.length("_dense")})
    made = made.withColumn("_after", F.slice("_hashes", 2, F.greatest(F.size("_hashes"), F.lit(1))))
    return made.select(*rows.columns, *[make().cast("double").alias(name) for name, make in STATISTICS.items()])


Test = tuple[str, bool, float]  # statistic, whether above, cut


def _split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float] | None:
    """The statistic and cut of most gain for the Newton loss, None if none helps."""
    g, h = gradient[rows], hessian[rows]
    best, found = 1e-9, None
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        cell = np.searchsorted(edges, x[rows, j], side="left")
        n = np.bincount(cell, minlength=len(edges) + 1).cumsum()[:-1]
        gl = np.bincount(cell, g, len(edges) + 1).cumsum()[:-1]
        hl = np.bincount(cell, h, len(edges) + 1).cumsum()[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl * gl / (hl + 1) + gr * gr / (hr + 1) - g.sum() ** 2 / (h.sum() + 1)
        gain[(n < LEAF) | (len(rows) - n < LEAF)] = -1
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (j, float(edges[int(gain.argmax())]))
    return found


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH) -> list[tuple[Test, ...]]:
    """The distinct paths to the nodes of gradient-boosted trees."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(middles if len(middles) <= CUTS else np.unique(np.quantile(x[:, j], np.linspace(0, 1, CUTS + 2)[1:-1])))
    odds = np.zeros(len(y))
    rules: dict[tuple[Test, ...], None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, hessian = y - p, p * (1 - p)
        left: list[tuple[np.ndarray, tuple[Test, ...]]] = [(np.arange(len(y)), ())]
        while left:
            rows, path = left.pop()
            found = _split(x, gradient, hessian, rows, cuts) if len(path) < depth and len(rows) >= 2 * LEAF else None
            if path:
                rules[tuple(sorted(path))] = None
            if found is None:
                odds[rows] += 0.3 * gradient[rows].sum() / (hessian[rows].sum() + 1)
                continue
            j, cut = found
            above = x[rows, j] > cut
            left += [(rows[above], (*path, (names[j], True, cut))), (rows[~above], (*path, (names[j], False, cut)))]
    return list(rules)


def holds(x: np.ndarray, names: list[str], rule: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, cut in rule:
        value = x[:, names.index(name)]
        out &= (value > cut) if above else (value <= cut)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient descent; the bias is not penalised."""
    n, k = r.shape
    weights, bias = np.zeros(k), math.log((y.sum() + 1) / (n - y.sum() + 1))
    step = 4 * n / (np.linalg.norm(np.hstack([r, np.ones((n, 1))]), 2) ** 2)
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(r @ ahead + ahead_bias))) - y
        moved = ahead - step * (r.T @ error) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = ahead_bias - step * error.mean()
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / after * (new - weights), new_bias + (t - 1) / after * (new_bias - bias)
        weights, bias, t = new, new_bias, after
    return weights, bias


class RuleEnsemble:
    """Weighted rules and a bias."""

    def __init__(self, rules: list[tuple[float, tuple[Test, ...]]], bias: float) -> None:
        self.rules, self.bias = rules, bias

    def column(self) -> Column:
        """The probability as one column over the statistics."""
        total = F.lit(float(self.bias))
        for weight, rule in self.rules:
            condition = F.lit(True)
            for name, above, cut in rule:
                condition &= (F.col(name) > cut) if above else (F.col(name) <= cut)
            total += F.when(condition, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))

    def probabilities(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * holds(x, names, rule)
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleEnsemble:
    """Rules and weights; with labels of one class only, or fewer rows than two leaves need, the bias alone."""
    y = y.astype(float)
    if len(y) < 2 * LEAF or y.min() == y.max():
        return RuleEnsemble([], math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    rules = tree_rules(x, y, names)
    weights, bias = lasso_logistic(np.stack([holds(x, names, r) for r in rules], 1).astype(float), y)
    return RuleEnsemble([(float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6], float(bias))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Train on a bounded sample of the labelled rows that `learn` (over doc_id) admits; numbers alone are collected."""
    names = list(STATISTICS)
    sample = labelled_sample(docs, labels, "quality", F.lit(True) if learn is None else learn, rows)
    found = sorted(tuple(r) for r in with_statistics(sample).select("doc_id", "label", *names).collect())  # `rows` at most
    return train(np.array([r[2:] for r in found]).reshape(-1, len(names)), np.array([r[1] for r in found]), names)


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """Every row of `docs` with its statistics and score (0 to 1).

    Null and empty texts have statistics of 0 and are scored by the rules that these meet; texts of any length
    are read whole; repeated rows score alike; an empty table gives an empty result; columns named like a
    statistic or the score are replaced, all others stay.
    """
    added = [*STATISTICS, "score"]
    rows = rows_apart(docs, [c for c in docs.columns if c not in added], text=F.col("text").cast("string"))
    return with_statistics(rows).withColumn("score", model.column()).select("row.*", *added)


def held_out(doc_id: Column) -> Column:
    return F.pmod(doc_key(doc_id), F.lit(3)) == 1


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    predicted = F.when(F.col("score") >= THRESHOLD, 1).otherwise(0)
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted.alias("predicted"))
