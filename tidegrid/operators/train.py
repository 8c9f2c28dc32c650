"""Fitting the forecaster by Adam, stopping when dev loss stays flat.

train() uses every train row: partitions compute the slopes of their rows, whose sum moves the weights, so the driver
holds weights only. fit() is the local form on arrays, in mini-batches, for a bounded sample."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profile import Profile
from .metrics import errors
from .model import HIDDEN, Weights, _dense, forward, predict, random_weights


def loss_and_slopes(w: Weights, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean squared error over all elements, and its derivative by every tensor."""
    out, a, r, k, t, alpha, joined = forward(w, x, m, parts=True)
    n = a.shape[1]
    miss = out - y
    d_out = 2 * miss / miss.size * (1 - out**2)
    d_joined = d_out @ w.out.T
    d_a, d_context = d_joined[:, :n], d_joined[:, n:]
    d_alpha = np.einsum("nh,njh->nj", d_context, k)
    d_k = alpha[:, :, None] * d_context[:, None, :]
    d_s = alpha * (d_alpha - (alpha * d_alpha).sum(axis=1, keepdims=True))
    d_t = d_s[:, :, None] * w.score * (1 - t**2)
    d_k = d_k + d_t
    d_q = d_t.sum(axis=1)
    d_a = d_a + d_q @ w.query.T
    d_r = d_k @ w.key.T
    return float((miss**2).mean()), {
        "x_w": np.einsum("nf,nif->if", d_a, x), "x_b": d_a.sum(axis=0), "m_w": np.einsum("njf,njif->if", d_r, m), "m_b": d_r.sum(axis=(0, 1)),
        "query": a.T @ d_q, "key": np.einsum("njf,njh->fh", r, d_k), "bias": d_t.sum(axis=(0, 1)), "score": np.einsum("nj,njh->h", d_s, t),
        "score_b": np.array([d_s.sum()]), "out": joined.T @ d_out,
    }


@dataclass
class Fit:
    weights: Weights
    history: list[tuple[int, float, float]]  # epoch, train loss, dev loss


@dataclass
class Adam:
    """clip: slopes are scaled down to this global norm (a deliberate choice against runaway steps); None applies them as
    they are."""

    rate: float = 1e-3
    clip: float | None = 5.0
    steps: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def move(self, w: Weights, slopes: dict[str, np.ndarray]) -> Weights:
        self.steps += 1
        norm = np.sqrt(sum((v**2).sum() for v in slopes.values()))
        scale = 1.0 if self.clip is None else min(1.0, self.clip / max(norm, 1e-12))
        new = {}
        for k, slope in slopes.items():
            v = slope * scale
            self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * v
            self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * v * v
            new[k] = getattr(w, k) - self.rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
        return replace(w, **new)


def fit(train: tuple[np.ndarray, ...], dev: tuple[np.ndarray, ...], w: Weights, epochs: int = 1000, batch: int = 32, rate: float = 1e-3, clip: float | None = 5.0, patience: int = 5) -> Fit:
    """The weights with the best dev loss. Batches run in order, unshuffled."""
    adam = Adam(rate, clip)
    best, best_loss, flat, history = w, 100.0, 0, []
    for epoch in range(epochs):
        total = 0.0
        for i in range(0, len(train[0]), batch):
            part = [t[i : i + batch] for t in train]
            loss, g = loss_and_slopes(w, *part)
            total += loss * len(part[0])
            w = adam.move(w, g)
        dev_loss = float(((forward(w, dev[0], dev[1]) - dev[2]) ** 2).mean()) if len(dev[0]) else total / max(1, len(train[0]))
        history.append((epoch, total / max(1, len(train[0])), dev_loss))
        if dev_loss < best_loss:
            best, best_loss, flat = w, dev_loss, 0
        elif (flat := flat + 1) >= patience:
            break
    return Fit(best, history)


def _arrays(samples: DataFrame, p: Profile) -> tuple[np.ndarray, ...]:
    rows = samples.select("x", "m", F.element_at("y", 1).alias("y")).collect()
    n = len(p.features)
    return (
        np.array([r["x"] for r in rows], float).reshape(-1, p.x_len, n),
        np.array([r["m"] for r in rows], float).reshape(-1, p.memory_days, p.m_len, n),
        np.array([r["y"] for r in rows], float).reshape(-1, n),
    )


def _sums(samples: DataFrame, w: Weights, p: Profile, slopes: bool) -> tuple[int, float, dict[str, np.ndarray]]:
    """Rows, the sum of their mean squared errors, and the sums of its slopes: one small row from each partition."""
    n, days, names = len(p.features), p.memory_days, [f.name for f in fields(w)]
    sent = samples.sparkSession.sparkContext.broadcast({k: getattr(w, k) for k in names})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, rows, lost, g = Weights(**sent.value), 0, 0.0, {k: np.zeros_like(sent.value[k]) for k in names}
        for b in batches:
            if not b.num_rows:
                continue
            x, m, y = _dense(b["x"], (p.x_len, n)), _dense(b["m"], (days, p.m_len, n)), _dense(b["y"], (n,))
            if slopes:
                loss, own = loss_and_slopes(weights, x, m, y)
                for k in names:
                    g[k] += own[k] * len(x)
            else:
                loss = float(((forward(weights, x, m) - y) ** 2).mean())
            rows, lost = rows + len(x), lost + loss * len(x)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([lost], pa.float64()), pa.array([pickle.dumps(g)], pa.binary())], ["rows", "lost", "slopes"])

    parts = samples.select("x", "m", F.element_at("y", 1).alias("y")).mapInArrow(run, "rows long, lost double, slopes binary").collect()  # a few kB a partition
    sent.unpersist()
    total = {k: np.zeros_like(getattr(w, k)) for k in names}
    for r in sorted(parts, key=lambda r: (r["rows"], r["lost"], r["slopes"])):
        own = pickle.loads(r["slopes"])
        total = {k: total[k] + own[k] for k in names}
    return sum(r["rows"] for r in parts), sum(sorted(r["lost"] for r in parts)), total


def train(samples: DataFrame, p: Profile, hidden: int = HIDDEN, seed: int = 0, epochs: int = 1000, rate: float = 1e-3, clip: float | None = 5.0, patience: int = 5) -> Fit:
    """From all rows of samples(x, m, y, part): each epoch one step on the slopes of all train rows, then the loss of all dev
    rows (without any, the train loss). samples are read twice an epoch, so they should be a table (files.kept).
    No train rows: the first weights."""
    w, adam = random_weights(p, hidden, seed), Adam(rate, clip)
    own, dev = samples.filter("part = 'train'"), samples.filter("part = 'dev'")
    best, best_loss, flat, history = w, 100.0, 0, []
    for epoch in range(epochs):
        n, lost, slopes = _sums(own, w, p, True)
        if not n:
            break
        w = adam.move(w, {k: v / n for k, v in slopes.items()})
        n_dev, dev_lost, _ = _sums(dev, w, p, False)
        dev_loss = dev_lost / n_dev if n_dev else lost / n
        history.append((epoch, lost / n, dev_loss))
        if dev_loss < best_loss:
            best, best_loss, flat = w, dev_loss, 0
        elif (flat := flat + 1) >= patience:
            break
    return Fit(best, history)


def train_on_sample(samples: DataFrame, p: Profile, hidden: int = HIDDEN, seed: int = 0, max_samples: int = 50_000, **settings) -> Fit:
    """The same in mini-batches on the driver, from at most about max_samples of the train rows, by hash, and a tenth of
    that of dev rows."""
    n = samples.filter("part = 'train'").count()
    keep = lambda most, total: F.pmod(F.xxhash64(p.key, "dt"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, most / max(1, total)))
    order = [p.key, "dt"]
    own = samples.filter("part = 'train'").filter(keep(max_samples, n)).orderBy(*order)
    dev = samples.filter("part = 'dev'").filter(keep(max_samples / 10, n * p.dev_ratio)).orderBy(*order)
    return fit(_arrays(own, p), _arrays(dev, p), random_weights(p, hidden, seed), **settings)


def evaluate(samples: DataFrame, w: Weights, p: Profile) -> DataFrame:
    """The error row of the forecasts."""
    return errors(predict(samples, w, p))
