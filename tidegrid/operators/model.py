"""The forecaster: an autoregressive head on x, the same on each memory day, additive attention over the days, and a
tanh output. Weights are data. Two forward passes that agree: NumPy on Arrow batches, and column expressions.

Every row attends to its own memory days only, so a prediction doesn't depend on what else is in its batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import dot, literal, plus, softmax, times
from ..profile import Profile

HIDDEN = 16


@dataclass(frozen=True)
class Weights:
    x_w: np.ndarray  # (x_len, features)
    x_b: np.ndarray
    m_w: np.ndarray  # (m_len, features)
    m_b: np.ndarray
    query: np.ndarray  # (features, hidden)
    key: np.ndarray
    bias: np.ndarray  # (hidden)
    score: np.ndarray
    score_b: np.ndarray  # (1)
    out: np.ndarray  # (features + hidden, features)

    @property
    def count(self) -> int:
        return sum(getattr(self, f.name).size for f in fields(self))


def shapes(p: Profile, hidden: int = HIDDEN) -> dict[str, tuple[int, ...]]:
    n = len(p.features)
    return {"x_w": (p.x_len, n), "x_b": (n,), "m_w": (p.m_len, n), "m_b": (n,), "query": (n, hidden), "key": (n, hidden), "bias": (hidden,), "score": (hidden,), "score_b": (1,), "out": (n + hidden, n)}


def fixed_weights(p: Profile, hidden: int = HIDDEN) -> Weights:
    """Weights by a formula that SQL can repeat: ((7 i + 13 j + 5 s) mod 23 - 11) / 20, s the number of the tensor."""
    made = {}
    for s, (name, shape) in enumerate(shapes(p, hidden).items()):
        i, j = np.meshgrid(np.arange(shape[0]), np.arange(shape[1] if len(shape) > 1 else 1), indexing="ij")
        made[name] = (((7 * i + 13 * j + 5 * s) % 23 - 11) / 20).reshape(shape)
    return Weights(**made)


def random_weights(p: Profile, hidden: int = HIDDEN, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    return Weights(**{k: rng.normal(0, 0.1, s) if not k.endswith("_b") and k != "bias" else np.zeros(s) for k, s in shapes(p, hidden).items()})


def save_weights(spark: SparkSession, w: Weights, path: str) -> None:
    """A table of tensor, at (place in it), shape, value."""
    rows = [(f.name, i, list(getattr(w, f.name).shape), float(v)) for f in fields(w) for i, v in enumerate(getattr(w, f.name).ravel())]
    spark.createDataFrame(rows, "tensor string, at int, shape array<int>, value double").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> Weights:
    rows = spark.read.parquet(path).orderBy("tensor", "at").collect()
    made: dict[str, list] = {}
    for r in rows:
        made.setdefault(r["tensor"], []).append(r)
    return Weights(**{k: np.array([r["value"] for r in v]).reshape(v[0]["shape"]) for k, v in made.items()})


def _in_order(terms: Iterator[np.ndarray]) -> np.ndarray:
    """The sum of the terms, first to last. A matrix product may add in another order for another number of rows, and a
    forecast would then depend in its last bits on its batch."""
    total = next(terms)
    for t in terms:
        total = total + t
    return total


def _times(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """v (..., i) by w (i, j)."""
    return _in_order(v[..., i, None] * w[i] for i in range(len(w)))


def forward(w: Weights, x: np.ndarray, m: np.ndarray, parts: bool = False):
    """x (n, x_len, features), m (n, days, m_len, features) -> (n, features); bit for bit the same in any batch."""
    a = _in_order(x[:, i] * w.x_w[i] for i in range(len(w.x_w))) + w.x_b
    r = _in_order(m[:, :, i] * w.m_w[i] for i in range(len(w.m_w))) + w.m_b
    q, k = _times(a, w.query), _times(r, w.key)
    t = np.tanh(q[:, None] + k + w.bias)
    s = _in_order(t[..., h] * w.score[h] for h in range(len(w.score))) + w.score_b
    e = np.exp(s - s.max(axis=1, keepdims=True))
    alpha = e / _in_order(e[:, j, None] for j in range(e.shape[1]))
    context = _in_order(alpha[:, j, None] * k[:, j] for j in range(k.shape[1]))
    joined = np.concatenate([a, context], axis=1)
    y = np.tanh(_times(joined, w.out))
    return (y, a, r, k, t, alpha, joined) if parts else y


def _dense(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    for _ in shape:
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, *shape)


def predict(samples: DataFrame, w: Weights, p: Profile) -> DataFrame:
    """samples(x, m, ...) + pred array<double>: one vectorised forward pass per Arrow batch, weights broadcast once."""
    n = len(p.features)
    sent = samples.sparkSession.sparkContext.broadcast({f.name: getattr(w, f.name) for f in fields(w)})
    days, m_len, x_len = p.memory_days, p.m_len, p.x_len

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(**sent.value)
        for b in batches:
            y = forward(weights, _dense(b["x"], (x_len, n)), _dense(b["m"], (days, m_len, n)))
            pred = pa.ListArray.from_arrays(np.arange(0, y.size + 1, n, dtype=np.int32), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pred], [*b.schema.names, "pred"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema) + ", pred array<double>"
    return samples.mapInArrow(run, schema)


def ar_head(window: Column, w: np.ndarray, b: np.ndarray) -> Column:
    """Per feature the weighted sum of a window's steps, plus the bias."""
    series = lambda j: F.transform(window, lambda v: F.element_at(v, j + 1))
    return F.array(*[dot(series(j), literal(w[:, j])) + F.lit(float(b[j])) for j in range(w.shape[1])])


def predict_native(samples: DataFrame, w: Weights, p: Profile) -> DataFrame:
    """The same in column expressions, each stage a column of its own so that none is evaluated twice."""
    tanh = lambda v: F.transform(v, F.tanh)
    d = samples.withColumn("__a", ar_head(F.col("x"), w.x_w, w.x_b)).withColumn("__r", F.transform("m", lambda day: ar_head(day, w.m_w, w.m_b)))
    d = d.withColumn("__q", times(F.col("__a"), w.query)).withColumn("__k", F.transform("__r", lambda r: times(r, w.key)))
    d = d.withColumn("__s", F.transform("__k", lambda k: dot(tanh(plus(F.col("__q"), k, literal(w.bias))), literal(w.score)) + F.lit(float(w.score_b[0]))))
    d = d.withColumn("__alpha", softmax(F.col("__s")))
    weighted = F.zip_with("__alpha", "__k", lambda a, k: F.transform(k, lambda v: v * a))
    zero = F.array(*[F.lit(0.0)] * w.key.shape[1])
    d = d.withColumn("__c", F.aggregate(weighted, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y)))
    return d.withColumn("pred", tanh(times(F.concat("__a", "__c"), w.out))).drop("__a", "__r", "__q", "__k", "__s", "__alpha", "__c")
