"""Quality classifier: a sparse ensemble of rules, compiled to Spark column expressions.

Text statistics are column expressions. On a bounded sample of labelled rows, shallow boosted trees
over the statistics are grown; every path from a root is a conjunctive rule; a logistic model with an
L1 penalty gives most rules the weight 0; the others become one column expression, so that scoring all
texts is a projection without shuffle or Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder

#: Most labelled rows that the model is fitted on.
SAMPLE_ROWS = 20_000

Condition = tuple[int, bool, float]  # statistic, True for <=, limit


def text_statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text column; null counts as empty, and no statistic is ever null."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.greatest(F.regexp_count(t, F.lit(r"\S+")), F.lit(1)).cast("double")
    lines = F.regexp_count(t, F.lit(r"\n")).cast("double") + 1
    share = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double") / n
    stats = {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "chars_per_word": n / words,
        "words_per_line": words / lines,
        "symbol_share": share(r"[#$%&*+/<=>@\\^_`{}~]"),
        "bar_share": share(r"\|"),
        "upper_share": share(r"\p{Lu}"),
        "exclaim_share": share(r"!"),
        "digit_share": share(r"[0-9]"),
        "stop_share": share(r"[.,;:?]"),
        "repeat_share": F.regexp_count(t, F.lit(r"(?<=^|\s)(\S{1,64}) (?=\1(?:\s|$))")).cast("double") / words,
        "distinct_share": F.size(F.array_distinct(F.split(t, r"\s+"))).cast("double") / words,
    }
    return {name: F.coalesce(c, F.lit(0.0)) for name, c in stats.items()}


@dataclass
class Rule:
    conditions: tuple[Condition, ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, below, limit in self.conditions:
            out &= (x[:, k] <= limit) == below
        return out


@dataclass
class RuleEnsemble:
    names: list[str]
    rules: list[Rule]
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for r in self.rules:
            z += r.weight * r.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """The score from columns named like the statistics."""
        terms = [F.lit(float(self.bias))]
        for r in self.rules:
            tests = [(F.col(self.names[k]) <= float(limit)) if below else (F.col(self.names[k]) > float(limit)) for k, below, limit in r.conditions]
            terms.append(F.when(_balanced(tests, lambda a, b: a & b), float(r.weight)).otherwise(0.0))
        return 1 / (1 + F.exp(-_balanced(terms, lambda a, b: a + b)))


def _balanced(parts: list[Column], join: Callable[[Column, Column], Column]) -> Column:
    """The parts joined pairwise, so that the expression stays flat enough to be compiled."""
    while len(parts) > 1:
        parts = [join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, path: tuple[Condition, ...], cuts: list[np.ndarray], least: int, out: list) -> None:
    """A regression tree on gradients; ``out`` gets (path, rows, value) of each node but the root."""
    if path:
        out.append((path, rows, grad[rows].sum() / (hess[rows].sum() + 1.0)))
    if depth == 0 or len(rows) < 2 * least:
        return
    g, h = grad[rows], hess[rows]
    base, best = g.sum() ** 2 / (h.sum() + 1), (1e-6, None)
    for k, limits in enumerate(cuts):
        if not len(limits):
            continue
        place = np.searchsorted(limits, x[rows, k], side="left")  # value <= limits[place]
        n = np.cumsum(np.bincount(place, minlength=len(limits) + 1))[:-1]
        gl, hl = (np.cumsum(np.bincount(place, v, len(limits) + 1))[:-1] for v in (g, h))
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - base
        gain[(n < least) | (len(rows) - n < least)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = (gain[at], (k, float(limits[at])))
    if best[1] is None:
        return
    k, limit = best[1]
    low = x[rows, k] <= limit
    for below, part in ((True, rows[low]), (False, rows[~low])):
        _grow(x, grad, hess, part, depth - 1, (*path, (k, below, limit)), cuts, least, out)


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty, by accelerated proximal gradient; the bias is free."""
    a = np.hstack([r, np.ones((len(r), 1))])
    step = 4 / (np.linalg.norm(a, 2) ** 2 / len(a) + 1e-9)
    w = v = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-np.clip(a @ v, -30, 30))) - y) / len(a)
        new = v - step * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 24, depth: int = 3, rate: float = 0.2, penalties: tuple[float, ...] = (0.02, 0.005, 0.002, 0.001), seed: int = 7) -> RuleEnsemble:
    """Rules from boosted trees and lasso weights; the penalty is chosen on a fifth of the rows.

    With fewer than 20 rows or one class only, the model is the share of label 1 alone.
    """
    y = y.astype(float)
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    if len(y) < 20 or y.min() == y.max():
        return RuleEnsemble(names, [], bias)
    rng = np.random.default_rng(seed)
    test = rng.random(len(y)) < 0.2
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, 64))) for c in x.T]
    z, found = np.full(len(y), bias), {}
    least = max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        rows = np.flatnonzero(~test & (rng.random(len(y)) < 0.6))
        nodes: list = []
        _grow(x, y - p, p * (1 - p), rows, depth, (), cuts, least, nodes)
        inner = {path[:-1] for path, _, _ in nodes}
        for path, _, value in nodes:
            if path not in inner:
                z += rate * value * Rule(path).holds(x)
            found.setdefault(frozenset(path), Rule(path))
    rules = [r for r in found.values() if 0 < r.holds(x[~test]).mean() < 1]
    if not rules:
        return RuleEnsemble(names, [], bias)
    r = np.stack([rule.holds(x) for rule in rules], axis=1).astype(float)
    loss = []
    for penalty in penalties:
        w, b = _lasso(r[~test], y[~test], penalty)
        q = np.clip(1 / (1 + np.exp(-(r[test] @ w + b))), 1e-6, 1 - 1e-6)
        loss.append(-np.mean(y[test] * np.log(q) + (1 - y[test]) * np.log(1 - q)))
    w, b = _lasso(r, y, penalties[int(np.argmin(loss))])
    return RuleEnsemble(names, [Rule(rule.conditions, float(v)) for rule, v in zip(rules, w, strict=True) if abs(v) > 1e-4], b)


def labelled_sample(labels: DataFrame, label: str, *, key: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """key and label of at most about ``most`` labelled rows outside the held-out fold, by a hash of the key."""
    own = labels.select(F.col(key), F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & F.col(key).isNotNull() & (crc_remainder(key, modulus) != held_out))
    n = own.count()
    parts = 1 << 20
    return own if n <= most else own.filter(F.pmod(F.xxhash64(key), F.lit(parts)) < int(parts * 0.95 * most / n)).limit(most)


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 5, held_out: int = 0, most: int = SAMPLE_ROWS) -> RuleEnsemble:
    """The ensemble from a bounded sample of ``labels`` joined to ``docs``."""
    sample = labelled_sample(labels, label, key=key, modulus=modulus, held_out=held_out, most=most)
    stats = text_statistics(F.col(text))
    names = list(stats)
    joined = docs.select(F.col(key), F.col(text)).join(F.broadcast(sample), key)  # of at most ``most`` keys
    rows = joined.select("y", *(c.alias(n) for n, c in stats.items())).toPandas().sort_values(["y", *names])
    return fit_rules(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def score_quality(docs: DataFrame, model: RuleEnsemble, *, key: str = "doc_id", text: str = "text", modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Null text is empty and is scored; null or repeated keys keep their rows; an empty table gives an
    empty result. Other columns of ``docs`` are not read.
    """
    stats = docs.select(F.col(key), (crc_remainder(key, modulus) == held_out).alias("held_out"), *(c.alias(n) for n, c in text_statistics(F.col(text)).items()))
    out = stats.select(key, "held_out", model.column().alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, model: RuleEnsemble, *, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns."""
    stats = {n: c.alias(n) for n, c in text_statistics(F.col(text)).items()}
    # a filter would be pushed below the statistics and repeat them in each rule; not past the partition's number
    rows = docs.select(F.struct("*").alias("row"), F.spark_partition_id().alias("part"), *stats.values())
    return rows.filter((model.column() >= threshold) & (F.col("part") >= 0)).select("row.*")
