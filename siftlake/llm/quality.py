"""Quality classifier: a sparse ensemble of rules over text statistics.

Small decision trees are grown on statistics of a bounded labelled sample; every path from a root is a conjunctive
rule; lasso logistic regression keeps a few rules with weights; these are compiled to one column expression, so
scoring runs inside Spark's generated code.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.llm.labelled import MAX_LABELLED, held_out, sigmoid, training_labels, with_labels
from siftlake.storage import Workspace, read_table

TREES, DEPTH, THRESHOLDS, MIN_LEAF = 40, 3, 24, 8
PENALTY = 0.002
CUT = 0.3


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern)).cast("double")


def statistics() -> dict[str, Column]:
    """Statistics of a non-null column `text`; all are finite, and 0 where there is nothing to divide by."""
    chars = F.greatest(F.length("text"), F.lit(1)).cast("double")
    words = F.greatest(_count(r"\S+"), F.lit(1.0))
    letters = F.greatest(_count(r"\p{L}"), F.lit(1.0))
    lines = F.split("text", "\n")
    return {
        "capital_share": _count(r"\p{Lu}") / letters,
        "letter_share": _count(r"\p{L}") / chars,
        "digit_share": _count(r"\p{N}") / chars,
        "symbol_share": _count(r"[^\p{L}\p{N}\s.,;:'\"()-]") / chars,
        "exclaimed_share": _count(r"!(?=\s|$)") / words,
        "symbol_word_share": _count(r"(?<=^|\s)[^\p{L}\p{N}\s]++(?=\s|$)") / words,
        # From the start of a run on and without going back, so a long run takes one pass.
        "symbol_tail_share": _count(r"(?<![^\p{L}\p{N}\s.,!?])[^\p{L}\p{N}\s.,!?]{2,}+(?=\s|$)") / words,
        "repeated_word_share": _count(r"(?<=^|\s)(\S++)(?=\s\1(?:\s|$))") / words,
        "sentence_share": _count(r"[.!?](?=\s|$)") / words,
        "chars_per_line": chars / F.size(lines).cast("double"),
        "letters_per_word": _count(r"\p{L}") / words,
        "distinct_line_share": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "log_words": F.log1p(_count(r"\S+")),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of its whole text (null: empty)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *[c.alias(name) for name, c in statistics().items()])


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, is it above?, threshold), with a weight."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        parts = [F.col(name) > t if above else F.col(name) <= t for name, above, t in self.tests]
        return F.when(reduce(lambda a, b: a & b, parts), F.lit(float(self.weight))).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[Rule, ...]

    def score(self) -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        total = reduce(lambda a, b: a + b, [r.column() for r in self.rules], F.lit(float(self.intercept)))
        return 1.0 / (1.0 + F.exp(-total))


def _grow(x: np.ndarray, y: np.ndarray, rng, depth: int, path: tuple, out: set) -> None:
    """Add the paths of a tree below `path`, split for least weighted Gini impurity."""
    if depth == 0 or len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return
    best = None
    for j in rng.choice(x.shape[1], size=max(2, x.shape[1] // 2), replace=False):
        column = x[:, j]
        for t in np.unique(np.quantile(column, np.linspace(0.02, 0.98, THRESHOLDS))):
            above = column > t
            n = int(above.sum())
            if n < MIN_LEAF or len(y) - n < MIN_LEAF:
                continue
            p, q = y[above].mean(), y[~above].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, j, float(t), above)
    if best is None:
        return
    _, j, t, above = best
    for side in (True, False):
        longer = (*path, (int(j), side, t))
        out.add(longer)
        _grow(x[above == side], y[above == side], rng, depth - 1, longer, out)


def _lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps. The intercept is free."""
    rows = np.hstack([np.ones((len(z), 1)), z])
    rate = 4.0 * len(z) / max(np.linalg.norm(rows, 2) ** 2, 1e-9)
    w = v = np.zeros(rows.shape[1])
    momentum = 1.0
    for _ in range(steps):
        gradient = rows.T @ (sigmoid(rows @ v) - y) / len(z)
        new = v - rate * gradient
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0.0)
        faster = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        v, w, momentum = new + (momentum - 1) / faster * (new - w), new, faster
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 11) -> RuleEnsemble:
    """Rules from trees on bootstrap samples, then lasso weights. One class only, or no rows: an intercept alone."""
    rate = (y.sum() + 0.5) / (len(y) + 1.0)
    prior = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(prior, ())
    rng = np.random.default_rng(seed)
    paths: set = set()
    for _ in range(TREES):
        some = rng.integers(0, len(y), size=min(len(y), 4000))
        _grow(x[some], y[some], rng, DEPTH, (), paths)
    found: dict[bytes, tuple] = {}
    for path in sorted(paths, key=lambda p: (len(p), p)):  # of rules with equal outcomes the shortest stays
        holds = reduce(np.logical_and, [(x[:, j] > t) == side for j, side, t in path])
        if holds.any() and not holds.all():
            found.setdefault(np.packbits(holds).tobytes(), (path, holds))
    if not found:
        return RuleEnsemble(prior, ())
    kept = list(found.values())
    intercept, weights = _lasso_logistic(np.stack([h for _, h in kept], axis=1).astype(np.float64), y, PENALTY)
    rules = [
        Rule(tuple((names[j], side, t) for j, side, t in path), float(w))
        for (path, _), w in zip(kept, weights, strict=True)
        if abs(w) > 1e-4
    ]
    return RuleEnsemble(intercept, tuple(rules))


def fit_quality(described: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED) -> RuleEnsemble:
    """Fit on at most `most` labelled training ids of described (doc_id and statistics); of rows with one id the least counts."""
    names = list(statistics())
    chosen = with_labels(described, training_labels(labels, label, most))
    rows = chosen.groupBy("doc_id", "label").agg(F.min(F.struct(*names)).alias("row")).select("label", "row.*").toArrow()
    x = np.stack([rows.column(n).to_numpy() for n in names], axis=1) if len(rows) else np.zeros((0, len(names)))
    order = np.lexsort(x.T) if len(rows) else []
    return fit_rules(x[order], rows.column("label").to_numpy().astype(np.float64)[order], names)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; the statistics are computed once and written.

    A null text is an empty one; a null id is held out. Rows are independent of each other, so repeated ids and rows pass
    through; texts of any length are read whole in one pass a statistic; other columns are not read. Without
    labelled rows of both classes every score is the labelled rows' rate; an empty table gives an empty one.
    """
    work = Workspace(docs.sparkSession, "quality")
    described = work.table(with_statistics(docs), "statistics")
    model = fit_quality(described, labels)
    scored = described.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, fitted on training rows of labels.quality."""
    return score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
