"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees are boosted on the statistics of a bounded sample of labelled
rows.  Every path to a node is a rule, a conjunction of comparisons.  A logistic
regression with an L1 penalty (lasso) weighs the rules, most of them zero, with
the penalty chosen on a part held back from the sample.  The rules left are
compiled into one Spark column expression, so scoring is a map over the table
in the JVM that shuffles nothing.

The sample is at most ``MAX_TRAIN`` labelled rows, those with the least hash of
their id, outside the held-out fold; only their statistics reach the driver.

Edge cases: a null text is an empty one and gets a score; rows without label,
or whose labels of one doc_id average to a half, are left out of the sample; without rows of
both labels the score is the smoothed share of label 1; repeated rows each give
a row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold_crc, table

MAX_TRAIN = 20_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
TREES, DEPTH, BINS, LEAST_LEAF = 24, 3, 32, 10
_BLANKS = r"[\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """What a score may depend on, each from the text alone."""
    t = F.coalesce(text, F.lit(""))
    per_word = lambda pattern: F.regexp_count(t, F.lit(pattern)) / F.greatest(F.size("__words"), F.lit(1))
    chars = F.greatest(F.length(t), F.lit(1))
    return {
        "n_words": F.log1p(F.size("__words").cast("double")),
        "word_length": F.length(t) / F.greatest(F.size("__words"), F.lit(1)),
        "symbols": per_word(r"[#*$%&|<>{}=_~^\\]"),
        "bangs": per_word(r"[!?]"),
        "stops": per_word(r"[.,;:]"),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / chars,
        "digits": F.regexp_count(t, F.lit(r"[0-9]")) / chars,
        "distinct": F.size(F.array_distinct("__words")) / F.greatest(F.size("__words"), F.lit(1)),
        "line_words": F.size("__words") / F.greatest(F.size("__lines"), F.lit(1)),
        "dup_lines": 1 - F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1)),
        "longest": F.log1p(F.coalesce(F.array_max(F.transform("__words", lambda w: F.length(w))), F.lit(0)).cast("double")),
    }


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each row."""
    t = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", "text", F.array_remove(F.split(t, _BLANKS), "").alias("__words"), F.array_remove(F.split(t, "\n"), "").alias("__lines"))
    return split.select("doc_id", *(c.cast("double").alias(name) for name, c in statistics(F.col("text")).items()))


NAMES = ("n_words", "word_length", "symbols", "bangs", "stops", "upper", "digits", "distinct", "line_words", "dup_lines", "longest")
#: A comparison: (statistic, threshold, above?).
Condition = tuple[int, float, bool]


@dataclass
class Ensemble:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for conditions, weight in self.rules:
            z += weight * _applies(conditions, x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self) -> Column:
        """The score as a column over the statistics."""
        z = F.lit(float(self.bias))
        for conditions, weight in self.rules:
            holds = reduce(lambda a, b: a & b, [F.col(NAMES[i]) > t if above else F.col(NAMES[i]) <= t for i, t, above in conditions])
            z = z + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def _applies(conditions: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for i, t, above in conditions:
        out &= x[:, i] > t if above else x[:, i] <= t
    return out


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple[Condition, ...]]:
    """The paths to all nodes of boosted trees."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])) for i in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    found: dict[tuple[Condition, ...], None] = {}

    def grow(rows: np.ndarray, path: tuple[Condition, ...], g: np.ndarray, h: np.ndarray, values: np.ndarray, everyone: np.ndarray) -> None:
        if path:
            found[tuple(sorted(path))] = None
        best = None
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for i, c in enumerate(cuts):
                if not len(c):
                    continue
                bins = binned[rows, i]
                n = np.cumsum(np.bincount(bins, minlength=len(c) + 1))[:-1]
                sg = np.cumsum(np.bincount(bins, g[rows], len(c) + 1))[:-1]
                sh = np.cumsum(np.bincount(bins, h[rows], len(c) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(n < LEAST_LEAF) | (len(rows) - n < LEAST_LEAF)] = -1
                k = int(gain.argmax())
                if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                    best = (gain[k], i, k)
        if best is None:
            values[everyone] = g[rows].sum() / (h[rows].sum() + 1)
            return
        _, i, k = best
        for above in (False, True):
            grow(rows[(binned[rows, i] > k) == above], (*path, (i, float(cuts[i][k]), above)), g, h, values, everyone[(binned[everyone, i] > k) == above])

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        values = np.zeros(len(y))
        grow(np.flatnonzero(rng.random(len(y)) < 0.5), (), y - p, p * (1 - p), values, np.arange(len(y)))
        margin += 0.3 * values
    return list(found)


def lasso(r: np.ndarray, y: np.ndarray, penalties: np.ndarray, steps: int = 150):
    """Logistic weights for each penalty, by accelerated proximal gradient, each from the last."""
    n, k = r.shape
    mean = r.mean(0)
    scale = np.sqrt(mean * (1 - mean)) + 1e-3
    z = (r - mean) / scale
    rate = 4 * n / max(np.linalg.norm(z, 2) ** 2, 1e-9)
    w, b = np.zeros(k), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    for penalty in penalties:
        v, vb, t = w.copy(), b, 1.0
        for _ in range(steps):
            e = 1 / (1 + np.exp(-(z @ v + vb))) - y
            new = v - rate * (z.T @ e) / n
            new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
            new_b = vb - rate * e.mean()
            after = (1 + np.sqrt(1 + 4 * t * t)) / 2
            v, vb = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
            w, b, t = new, new_b, after
        yield w / scale, b - (w / scale) @ mean


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Ensemble:
    """The rule ensemble of a sample; ``y`` is 0 or 1."""
    prior = (y.sum() + 1) / (len(y) + 2)
    constant = Ensemble(float(np.log(prior / (1 - prior))), [])
    if len(y) < 4 * LEAST_LEAF or y.min() == y.max():
        return constant
    rules = tree_rules(x, y, seed)
    if not rules:
        return constant
    r = np.stack([_applies(c, x) for c in rules], 1).astype(float)
    check = np.random.default_rng(seed).random(len(y)) < 0.25
    penalties = 0.1 * 0.6 ** np.arange(14)
    losses = []
    for w, b in lasso(r[~check], y[~check], penalties):
        p = np.clip(1 / (1 + np.exp(-(r[check] @ w + b))), 1e-9, 1 - 1e-9)
        losses.append(-(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean())
    chosen = int(np.argmin(losses))
    *_, (w, b) = lasso(r, y, penalties[: chosen + 1])
    return Ensemble(float(b), [(rules[i], float(w[i])) for i in np.flatnonzero(np.abs(w) > 1e-6)])


def sample_labels(labels: DataFrame, name: str, folds: int, held_out: int, most: int) -> DataFrame:
    """At most ``most`` (doc_id, y) outside the held-out fold, those with the least hash of their id."""
    rows = labels.filter(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(name).alias("y"))
    rows = rows.filter((F.col("y") != 0.5) & (fold_crc("doc_id", folds) != held_out))
    return rows.select("doc_id", (F.col("y") > 0.5).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Ensemble:
    chosen = sample_labels(labels, "quality", FOLDS, HELD_OUT, most)
    # At most ``most`` rows of 16 bytes: safe to broadcast, so that the texts stay where they are.
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    data = rows.join(F.broadcast(chosen), "doc_id").select(*NAMES, "y").toPandas().to_numpy(float)
    data = data[np.lexsort(data.T)] if len(data) else data.reshape(0, len(NAMES) + 1)
    return fit(data[:, :-1], data[:, -1]) if len(data) else Ensemble(0.0, [])


def score_quality(docs: DataFrame, model: Ensemble) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", F.coalesce(fold_crc("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
