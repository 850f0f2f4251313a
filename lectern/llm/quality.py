"""Quality classifier: a sparse rule ensemble compiled into Spark columns.

Boosted shallow trees over text statistics are fitted on a bounded sample of
labelled rows; every path from a root becomes a conjunctive rule; a logistic
lasso over the rules keeps few of them. The kept rules are Spark expressions,
so scoring needs no model object on the executors, only statistics of the text.

Defined results: a null text is the empty text; an empty text has a score like
any other; with no labelled rows, or labels of one kind only, every score is
the prior (0.5 with no labels); null labels and labels of unknown documents are
not used; texts are read whole, however long; repeated rows are scored row by
row; an empty table gives an empty table; columns beside key and text are not
looked at and stay, but one that is named as the score is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name
from lectern.llm.textstats import NAMES, with_stats

#: Labelled rows that the model is fitted on, at most; chosen by a hash of the key.
SAMPLE_ROWS = 12_000
TREES, DEPTH, LEARN = 40, 3, 0.3
#: Weight of the lasso against the mean logistic loss.
LASSO = 0.002
STEPS = 600


@dataclass(frozen=True)
class Rule:
    """All of (statistic, threshold, above) hold."""

    terms: tuple[tuple[int, float, bool], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, t, above in self.terms:
            out &= (x[:, k] > t) == above
        return out

    def column(self, stats: Column) -> Column:
        tests = [(stats[k] > F.lit(t)) if above else (stats[k] <= F.lit(t)) for k, t, above in self.terms]
        both = tests[0]
        for test in tests[1:]:
            both = both & test
        return F.when(both, F.lit(self.weight)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def score(self, stats: Column) -> Column:
        total = F.lit(self.bias)
        for rule in self.rules:
            total = total + rule.column(stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(x, edges, bins, grad, hess, rows, depth, terms, out):
    """One regression tree on the gradients; appends (terms, rows, value) for every node below the root."""
    if terms:
        out.append((terms, rows, -grad[rows].sum() / (hess[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 40:
        return
    best = (1e-6, None, None)
    g_all, h_all = grad[rows].sum(), hess[rows].sum()
    for k in range(x.shape[1]):
        if not len(edges[k]):
            continue
        b = bins[rows, k]
        g = np.cumsum(np.bincount(b, grad[rows], len(edges[k]) + 1))[:-1]
        h = np.cumsum(np.bincount(b, hess[rows], len(edges[k]) + 1))[:-1]
        c = np.cumsum(np.bincount(b, minlength=len(edges[k]) + 1))[:-1]
        gain = g * g / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
        gain[(c < 10) | (c > len(rows) - 10)] = -1
        if gain.max(initial=-1) > best[0]:
            best = (gain.max(), k, int(gain.argmax()))
    _, k, at = best
    if k is None:
        return
    above = bins[rows, k] > at
    for side in (False, True):
        _grow(x, edges, bins, grad, hess, rows[above == side], depth - 1, (*terms, (k, float(edges[k][at]), side)), out)


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, their paths as rules, and the logistic lasso over the rules."""
    if not len(y):
        return RuleModel(0.0, ())
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleModel(bias, ())
    edges = [np.unique(np.quantile(col, np.linspace(0.01, 0.99, 48)))[:-1] for col in x.T]
    bins = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], 1)
    z, found = np.full(len(y), bias), {}
    for _ in range(TREES):
        p = _sigmoid(z)
        nodes: list = []
        _grow(x, edges, bins, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), nodes)
        parents = {terms[:-1] for terms, _, _ in nodes}
        for terms, rows, value in nodes:
            found.setdefault(terms, Rule(terms))
            if terms not in parents:
                z[rows] += LEARN * value
    rules = list(found.values())
    if not rules:
        return RuleModel(bias, ())
    a = np.stack([r.holds(x) for r in rules], 1).astype(np.float64)
    weights, bias = _lasso(a, y, bias)
    return RuleModel(bias, tuple(Rule(r.terms, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4))


def _lasso(a: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum on the mean logistic loss; the bias is not shrunk."""
    n = len(y)
    mean = a.mean(0)
    c = a - mean
    v = np.random.default_rng(0).normal(size=a.shape[1])
    for _ in range(20):  # largest eigenvalue, for the step
        v = c.T @ (c @ v)
        v /= np.linalg.norm(v) + 1e-300
    step = 1 / (0.25 * (np.linalg.norm(c @ v) ** 2 / n + 1) * 1.05)
    w = np.zeros(a.shape[1])
    b = bias
    w_ahead, b_ahead, t = w, b, 1.0
    for _ in range(STEPS):
        r = _sigmoid(c @ w_ahead + b_ahead) - y
        w_next = w_ahead - step * (c.T @ r) / n
        w_next = np.sign(w_next) * np.maximum(np.abs(w_next) - step * LASSO, 0)
        b_next = b_ahead - step * r.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_ahead, b_ahead = w_next + (t - 1) / t_next * (w_next - w), b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, float(b - mean @ w)


def labelled_sample(labels: DataFrame, key: str, label: str, use: Column, rows: int) -> DataFrame:
    """At most `rows` rows of (key, label) with a label of 0 or 1, the same ones in every run."""
    return (
        labels.where(use & F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(label).alias("__label"))
        .orderBy(F.xxhash64("__key"), "__key")
        .limit(rows)
    )


def fit(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """Fit on the labelled documents that `use`, a condition on labels, lets through.

    The sample has SAMPLE_ROWS keys at most, so it may be broadcast and its
    statistics collected: SAMPLE_ROWS x len(NAMES) numbers.
    """
    picked = labelled_sample(labels, key, label, use, SAMPLE_ROWS)
    own = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")).join(F.broadcast(picked), "__key")
    got = with_stats(own, "__text", "__stats").select("__key", "__label", "__stats").toPandas().sort_values("__key", kind="stable")
    got = got.drop_duplicates("__key")
    if got.empty:
        return RuleModel(0.0, ())
    return fit_rules(np.stack(got["__stats"].to_list()).reshape(-1, len(NAMES)), got["__label"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """docs and the score of each text; all columns of docs stay, but one named `out` is replaced."""
    stats = free_name("__stats", [*docs.columns, out])
    rows = with_stats(docs, text, stats).select("*", model.score(F.col(stats)).alias(free_name("__score", docs.columns)))
    return rows.select(*(c for c in docs.columns if c.lower() != out.lower()), F.col(rows.columns[-1]).alias(out))
