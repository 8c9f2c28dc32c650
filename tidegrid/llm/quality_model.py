"""Quality classifier by positive-unlabelled learning (operator 4).

Trusted positives are labelled documents of quality 1 in the training fold; the unlabelled side is web text whose labels,
if any, are not looked at; no negative label is used. A first model of positive against unlabelled yields the class prior:
the least ratio, over score thresholds, of unlabelled to positive mass at or above the threshold (each half of the
samples scored by a model of the other half). The final model
minimises the non-negative risk  prior * R+(P) + max(0, R-(U) - prior * R-(P))  with the sigmoid loss; the sigmoid of its
value is the score.

Features are shares and rates of text statistics, each cut into quantile bins of the unlabelled sample (so the model is
additive but not linear). Both samples are bounded and chosen by hash; only their statistics reach the driver. Scoring is
one Arrow pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import table, training_fold
from .quality_rules import COUNTS, count_text

THRESHOLD = 0.3
NAMES = ("words", "mean_word", "symbols", "repeats", "dup_lines", "upper", "marks", "digits", "distinct", "line_words", "ends")


def statistics(text: bytes) -> tuple[float, ...]:
    """NAMES of one UTF-8 text; all zero for an empty one."""
    c = dict(zip(COUNTS, count_text(text), strict=True))
    n = c["n_words"]
    if not n:
        return (0.0,) * len(NAMES)
    words = text.split()
    ends = sum(w[-1] in b".!?" for w in words)
    chars = max(1, c["word_chars"])
    return (np.log1p(n), c["word_chars"] / n, c["n_symbols"] / n, c["n_repeat_words"] / n, c["n_dup_lines"] / max(1, c["n_lines"]), c["n_upper"] / chars, c["n_marks"] / n, c["n_digits"] / chars, len(set(words)) / n, np.log1p(n / max(1, c["n_lines"])), ends / n)


@arrow_udf(T.ArrayType(T.DoubleType()))
def text_statistics(texts: pa.Array) -> pa.Array:
    return pa.array([statistics(t.as_py() or b"") for t in texts.cast(pa.binary())], pa.list_(pa.float64()))


text_statistics = text_statistics.asNondeterministic()


@dataclass
class QualityModel:
    edges: list[np.ndarray]
    weights: np.ndarray
    bias: float
    prior: float

    def design(self, x: np.ndarray) -> np.ndarray:
        """Thermometer code: a column for every edge that a value exceeds."""
        return np.concatenate([(x[:, [j]] > e).astype(np.float64) for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.design(x) @ self.weights + self.bias if len(x) else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(w: np.ndarray, slope_at, rounds: int, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for k in range(1, rounds + 1):
        slope = slope_at(w) + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def _apart(p: np.ndarray, u: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (last: bias) of plain logistic regression of positive against unlabelled, both sides weighing the same."""

    def slope(w: np.ndarray) -> np.ndarray:
        return (u * _sigmoid(u @ w)[:, None]).mean(axis=0) / 2 - (p * (1 - _sigmoid(p @ w))[:, None]).mean(axis=0) / 2

    return _adam(np.zeros(p.shape[1]), slope, rounds)


def _non_negative(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, rounds: int) -> np.ndarray:
    """From w on, descent of prior R+(P) + max(0, R-(U) - prior R-(P)). Where the second part is below zero, the step
    undoes it instead, which is what keeps the model from fitting the sample's noise."""

    def slope(w: np.ndarray) -> np.ndarray:
        sp, su = _sigmoid(p @ w), _sigmoid(u @ w)  # R-: the mean score; R+: the mean of 1 - score
        up, uu = (p * (sp * (1 - sp))[:, None]).mean(axis=0), (u * (su * (1 - su))[:, None]).mean(axis=0)
        return uu - 2 * prior * up if su.mean() >= prior * sp.mean() else prior * up - uu

    return _adam(w, slope, rounds)


def class_prior(p_scores: np.ndarray, u_scores: np.ndarray) -> float:
    """The least ratio of unlabelled to positive mass above a threshold that leaves half of the positives or more."""
    cuts = np.quantile(p_scores, np.linspace(0.0, 0.5, 51))
    p = np.array([(p_scores >= c).mean() for c in cuts])
    u = np.array([(u_scores >= c).mean() for c in cuts])
    slack = np.sqrt(u * (1 - u) / len(u_scores)) + np.sqrt(p * (1 - p) / len(p_scores))  # one standard error each
    return float(np.clip(((u + slack) / p).min(), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, bins: int = 12, rounds: int = 400) -> QualityModel | None:
    """None if either sample is empty."""
    if not len(positive) or not len(unlabelled):
        return None
    edges = []
    for j in range(unlabelled.shape[1]):
        both = np.concatenate([np.quantile(unlabelled[:, j], np.linspace(0, 1, bins)), np.quantile(positive[:, j], np.linspace(0, 1, bins))])
        edges.append(np.unique(both)[:-1] if len(np.unique(both)) > 1 else np.empty(0))
    model = QualityModel(edges, np.zeros(sum(map(len, edges))), 0.0, 0.5)
    p, u = (np.c_[model.design(x), np.ones(len(x))] for x in (positive, unlabelled))
    side = [_apart(p[k::2], u[k::2], rounds // 2) if min(len(p), len(u)) > 1 else np.zeros(p.shape[1]) for k in (0, 1)]
    scores = lambda x: np.concatenate([x[1::2] @ side[0], x[::2] @ side[1]])  # noqa: E731  each half by the other's model
    model.prior = class_prior(scores(p), scores(u))
    # start where the ratio of the two densities puts even odds at 0 and pure positives at 4
    w = _apart(p, u, rounds // 2)
    w[-1] -= np.log(0.5 / model.prior)
    w = _non_negative(p, u, model.prior, w * (4 / np.log(2)), rounds)
    model.weights, model.bias = w[:-1], float(w[-1])
    return model


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 5_000, max_unlabelled: int = 5_000) -> QualityModel | None:
    """A model from about so many documents of either kind, chosen by hash, and twice as many at most, whatever ids repeat.
    Labels are read in the training fold only (null labels and ids aside), and only to find positives; repeated label
    rows count once, repeated documents as often as they stand there. None where either kind is empty. Of docs and labels only
    doc_id, text and quality are read, so other columns may have any names."""
    fold = training_fold(F.col("doc_id"))
    known = labels.filter((F.col("quality") == 1) & fold).select("doc_id").distinct()
    n_known, n_docs = known.count(), docs.count()
    share = lambda most, n, salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, n)))
    p = docs.select("doc_id", "text").join(known.filter(share(max_positive, n_known, 1)), "doc_id", "left_semi").withColumn("side", F.lit(1))
    u = docs.select("doc_id", "text").filter(F.coalesce(share(max_unlabelled, n_docs, 2), F.lit(False))).withColumn("side", F.lit(0))
    bounded = lambda d, most: d.select("doc_id", "side", text_statistics("text").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * most)
    rows = bounded(p, max_positive).unionByName(bounded(u, max_unlabelled)).toPandas().sort_values(["side", "doc_id"], kind="stable")
    x = lambda side: np.array(rows.loc[rows["side"] == side, "x"].tolist(), float).reshape(-1, len(NAMES))
    return fit(x(1), x(0))


def scored(model: QualityModel | None):
    """text -> score, a function of the text alone; 0.5 everywhere without a model. Null and empty texts score as a text
    without words, equal texts alike, long ones by the whole."""

    @arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        if model is None or not len(texts):
            return pa.array([0.5] * len(texts), pa.float64())
        x = np.array([statistics(t.as_py() or b"") for t in texts.cast(pa.binary())], float).reshape(-1, len(NAMES))
        return pa.array(model.score(x))

    return score.asNondeterministic()


def keep_good(docs: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least threshold; columns as they were, whatever their names. Repeated rows and null ids
    are rows like others; no rows: no rows."""
    return docs.select(F.struct("*").alias("row"), scored(model)("text").alias("score")).filter(F.col("score") >= threshold).select("row.*")


def op4_quality_model(spark, sf_dir):
    """Contract query: the quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~training_fold(F.col("doc_id")), F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held_out, scored(model)("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
