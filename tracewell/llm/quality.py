"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Boosted trees are grown on statistics of labelled texts; the path to each of their nodes is
a conjunctive rule; a lasso-penalised logistic regression weighs the rules; those with a
weight are compiled into one Spark column expression.  Statistics and score are built-in
functions, so scoring needs no Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm.toxicity import held_out, training_rows

MAX_TRAINING_ROWS = 20_000
WORD = "[^\\x20\\x09-\\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a whole text; of an empty one all are 0."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.greatest(F.length(t), F.lit(1))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    lines = F.split(t, "\n")

    def share(pattern):
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))) / n

    w = F.greatest(F.size(words), F.lit(1))
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "log_words": F.log1p(F.size(words).cast("double")),
        "word_length": F.length(F.regexp_replace(t, "[\\x20\\x09-\\x0D]", "")) / w,
        "distinct_words": F.size(F.array_distinct(words)) / w,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.log1p(w / F.size(lines)),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "stops": share("[.]"),
        "marks": share("[!-&*+/:-@\\[-`{-~]"),
        "bars": share("[|]"),
        "doubled": share("([!#$%&*?|])\\1"),
    }


NAMES = ("log_chars", "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "upper", "digits", "stops", "marks", "bars", "doubled")


@dataclass
class Rules:
    """Conjunctions of (statistic, is above, threshold), a weight for each, and the intercept."""

    rules: list[tuple[tuple[int, bool, float], ...]]
    weights: list[float]
    intercept: float


def _tree(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> list:
    """Paths to the nodes of a regression tree on gradients, with each leaf's value."""
    out = []

    def grow(rows, path):
        total, weight = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if len(path) < depth and len(rows) >= 40:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gs = np.cumsum(np.bincount(bins[rows, f], weights=g[rows], minlength=len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(bins[rows, f], weights=h[rows], minlength=len(c) + 1))[:-1]
                gain = gs**2 / (hs + 1) + (total - gs) ** 2 / (weight - hs + 1) - total**2 / (weight + 1)
                gain[(hs < 2) | (weight - hs < 2)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k)
        leaf = best[1] is None
        if path:
            out.append((tuple(path), rows, total / (weight + 1), leaf))
        if not leaf:
            _, f, k = best
            above = bins[rows, f] > k
            grow(rows[~above], [*path, (f, False, float(cuts[f][k]))])
            grow(rows[above], [*path, (f, True, float(cuts[f][k]))])

    grow(np.arange(len(x)), [])
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, penalty: float = 2e-4, steps: int = 400) -> Rules:
    """Trees, their rules and the lasso logistic weights; without both classes, only an intercept."""
    n = len(y)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if not n or y.min() == y.max():
        return Rules([], [], prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.005, 0.995, 100))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    score, rules = np.full(n, prior), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        for path, rows, value, leaf in _tree(x, cuts, bins, y - p, p * (1 - p), depth):
            key = tuple(sorted(path))
            rules.setdefault(key, rows)
            if leaf:
                score[rows] += 0.3 * value
    keys = [k for k, rows in rules.items() if 0.001 * n <= len(rows) <= 0.999 * n]
    if not keys:
        return Rules([], [], prior)
    a = np.zeros((n, len(keys)))
    for j, k in enumerate(keys):
        a[rules[k], j] = 1
    mean, spread = a.mean(0), a.std(0) + 1e-9
    a = (a - mean) / spread
    rate = 4 * n / np.linalg.norm(a, 2) ** 2
    w, b, z, c, t = np.zeros(len(keys)), prior, np.zeros(len(keys)), prior, 1.0
    for _ in range(steps):  # accelerated proximal gradient
        e = (1 / (1 + np.exp(-(a @ z + c))) - y) / n
        new = z - rate * (a.T @ e)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - 4 * e.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    used = np.flatnonzero(np.abs(w) > 1e-6)
    real = w[used] / spread[used]
    return Rules([keys[j] for j in used], real.tolist(), float(b - (real * mean[used]).sum()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_TRAINING_ROWS) -> Rules:
    """Learn from the statistics of at most ``limit`` labelled documents that are not held out."""
    rows = training_rows(docs, labels, label, limit)
    found = rows.select(*(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()), "label").toArrow()
    x = np.stack([found.column(k).to_numpy() for k in NAMES], 1)
    y = (found.column("label").to_numpy() > 0).astype(float)
    order = np.lexsort((y, *x.T))  # the same rules whatever the order of the rows
    return fit(x[order], y[order])


def probability(rules: Rules, stats: dict[str, Column]) -> Column:
    """The rules as one column expression."""
    total = F.lit(rules.intercept)
    for rule, weight in zip(rules.rules, rules.weights, strict=True):
        holds = F.lit(True)
        for f, above, cut in rule:
            holds = holds & (stats[NAMES[f]] > cut if above else stats[NAMES[f]] <= cut)
        total = total + F.when(holds, weight).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Null texts count as empty, and empty texts get a score too.  Equal texts score alike.
    Without labels of both classes every score is the smoothed share of the label 1.
    Columns besides doc_id and text are ignored.
    """
    rules = train(docs, labels)
    stats = docs.select("doc_id", *(c.cast("double").alias(k) for k, c in statistics(F.col("text")).items()))
    scored = stats.select("doc_id", held_out("doc_id").alias("held_out"), probability(rules, {k: F.col(k) for k in NAMES}).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
