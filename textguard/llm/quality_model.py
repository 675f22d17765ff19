"""A quality classifier made of sparse rules.

Small boosted trees over text statistics give conjunctive rules, one for each path from the root;
a logistic regression with an l1 penalty picks few of them. The rules are compiled into one Spark
column expression, so scoring is a projection over the statistics, which are column expressions
themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textguard.functions.binding import attach
from textguard.llm.common import SPACES, words

#: Bound of the training sample, in rows of statistics.
SAMPLE = 20_000
SEED = 11
TREES = 30
DEPTH = 3
LEAF = 20
BINS = 32
SHRINK = 0.3
PENALTY = 5e-4
STEPS = 400

FEATURES = (
    "log_words", "mean_word", "symbol_share", "digit_share", "stop_share", "bang_share", "upper_share",
    "distinct_share", "again_share", "short_share", "line_words", "dup_lines",
)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the statistics of each whole text, as doubles; of null and empty texts, zeros."""
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    df = attach(df, "w", words(F.col("text")))
    text, w = F.col("text"), F.col("w")
    chars = F.length(F.translate(text, SPACES, ""))
    n = F.size(w)

    def of(chars_of: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars_of, ""))

    def share(part: Column, whole: Column) -> Column:
        return part / F.greatest(whole, F.lit(1))

    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, SPACES, "")) != "")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = df.withColumn("lines", F.size(lines)).withColumn("unlike", F.size(F.array_distinct(lines)))
    values = {
        "log_words": F.log1p(n.cast("double")),
        "mean_word": share(chars, n),
        "symbol_share": share(of("#*$%&|<>@{}[]\\^~_="), chars),
        "digit_share": share(of("0123456789"), chars),
        "stop_share": share(of(".,;:"), n),
        "bang_share": share(of("!?"), n),
        "upper_share": share(of(upper), chars),
        "distinct_share": share(F.size(F.array_distinct(w)), n),
        "again_share": share(F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))), n),
        "short_share": share(F.size(F.filter(w, lambda x: F.length(x) <= 2)), n),
        "line_words": share(n, F.col("lines")),
        "dup_lines": share(F.col("lines") - F.col("unlike"), F.col("lines")),
    }
    return df.select(*keep, *[values[f].cast("double").alias(f) for f in FEATURES])


@dataclass(frozen=True)
class Condition:
    feature: str
    bound: float
    above: bool

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.bound if self.above else c <= self.bound

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.bound if self.above else x[self.feature] <= self.bound


Rule = tuple[Condition, ...]


@dataclass
class Model:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The score as a column over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights):
            held = rule[0].column()
            for condition in rule[1:]:
                held = held & condition.column()
            total = total + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(x: np.ndarray, bounds: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, usable: np.ndarray, path: Rule, found: set, update: np.ndarray):
    """Splits ``rows`` where the squared gradient falls most; ``x`` holds bin numbers."""
    value = gradient[rows].sum() / (weight[rows].sum() + 1.0)
    best = (1e-6, None, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for f in usable:
            if not len(bounds[f]):
                continue
            bins = x[rows, f]
            g = np.cumsum(np.bincount(bins, gradient[rows], len(bounds[f]) + 1))
            h = np.cumsum(np.bincount(bins, weight[rows], len(bounds[f]) + 1))
            n = np.cumsum(np.bincount(bins, minlength=len(bounds[f]) + 1))
            gain = g**2 / (h + 1) + (g[-1] - g) ** 2 / (h[-1] - h + 1) - g[-1] ** 2 / (h[-1] + 1)
            gain[(n < LEAF) | (len(rows) - n < LEAF)] = 0
            at = int(gain[:-1].argmax())
            if gain[at] > best[0]:
                best = (gain[at], f, at)
    if best[1] is None:
        update[rows] = SHRINK * value
        return
    _, f, at = best
    low = x[rows, f] <= at
    for part, above in ((rows[low], False), (rows[~low], True)):
        longer = (*path, Condition(FEATURES[f], float(bounds[f][at]), above))
        found.add(longer)
        _grow(x, bounds, gradient, weight, part, usable, longer, found, update)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The paths of boosted trees, each grown on a half of the rows and two thirds of the features."""
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(b, c, "left") for b, c in zip(bounds, x.T)], axis=1)
    score, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), set()
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        usable = rng.choice(x.shape[1], max(1, 2 * x.shape[1] // 3), replace=False)
        update = np.zeros(len(y))
        _grow(binned, bounds, gradient, weight, rows, np.sort(usable), (), found, update)
        score = score + update
    return sorted(found, key=repr)


def lasso(held: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Logistic weights with an l1 penalty, by accelerated proximal gradient steps; the bias is free."""
    n = len(y)
    design = np.c_[held, np.ones(n)]
    pace = 4 * n / max(1e-9, np.linalg.norm(design, 2) ** 2)
    w = ahead = np.zeros(design.shape[1])
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ ahead, -30, 30)))
        step = ahead - pace * (design.T @ (p - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - pace * penalty, 0)
        new[-1] = step[-1]
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / following * (new - w), new, following
    return w[:-1], float(w[-1])


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit statistics (a column per feature) to labels 0 and 1. Without rows of both labels, or
    where no split separates ``LEAF`` rows from the others (few rows, equal statistics), the score
    is the same everywhere: the share of label 1, or a half without rows."""
    rules = tree_rules(x, y) if len(np.unique(y)) == 2 else []
    if not rules:
        share = min(0.99, max(0.01, y.mean() if len(y) else 0.5))
        return Model([], np.empty(0), float(np.log(share / (1 - share))))
    columns = dict(zip(FEATURES, x.T))
    held = np.stack([np.logical_and.reduce([c.holds(columns) for c in r]) for r in rules], axis=1).astype(float)
    held, first = np.unique(held, axis=1, return_index=True)
    weights, bias = lasso(held, y)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return Model([rules[first[i]] for i in used], weights[used], bias)


def training_rows(stats: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and quality of at most ``sample`` labelled rows, the first by a hash of doc_id.

    A task sends the driver only rows whose hash lies below a share that holds the sample and a
    half more of all labels, so what is sent does not grow with the number of tasks. Labels without an
    id count for no row; a row labelled twice counts twice.
    """
    named = labels.select(F.col("doc_id").alias("of"), "quality").filter(F.col("quality").isin(0, 1) & F.col("of").isNotNull())
    fit = stats.filter(learn).join(named, F.col("doc_id") == F.col("of"))
    place = F.xxhash64(F.lit(SEED), "doc_id")
    share = 1.5 * sample / max(1, fit.count())
    if share < 1:
        near = fit.filter(place < int(share * 2**64) - 2**63)
        fit = near if near.limit(sample).count() >= sample else fit  # one id may hold very many rows
    rows = fit.orderBy(place, "quality", *FEATURES).limit(sample).select(*FEATURES, "quality").collect()
    data = np.array([tuple(r) for r in rows], float).reshape(len(rows), len(FEATURES) + 1)
    return data[:, :-1], data[:, -1]
