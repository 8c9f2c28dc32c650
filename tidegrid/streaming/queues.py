"""As-of features over a stream: per-key state of the last steps, one sample out for each step that completes one.

The state of a key is what the longest memory needs, memory_days days of steps and one more, whatever the stream's
length. A row that comes later than a newer one of its key is put into its place in the state, but emits nothing: its
time has been answered for. For equal times the last row wins. Rows older than the state are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.datetimes import wall_seconds
from ..functions.vectors import assemble
from ..operators.resample import feature_means, on_grid
from ..profile import Profile

DAY = 86_400


def _sample(at: int, times: np.ndarray, values: np.ndarray, p: Profile):
    """x that ends at `at` and the memory of the next step, or None if a step is missing."""
    step = p.step_minutes * 60
    wanted_x = at + step * np.arange(1 - p.x_len, 1)
    ends = at + step - DAY * np.arange(p.memory_days, 0, -1)
    wanted_m = ends[:, None] + step * np.arange(1 - p.m_len, 1)
    wanted = np.concatenate([wanted_x, wanted_m.ravel()])
    found = np.minimum(np.searchsorted(times, wanted), len(times) - 1)
    if not (times[found] == wanted).all():
        return None
    v = values[found]
    return v[: p.x_len], v[p.x_len :].reshape(p.memory_days, p.m_len, -1)


def live_features(rows: DataFrame, p: Profile) -> DataFrame:
    """key, at, x, m: what asof.features_at gives at each newly arrived step. rows: a stream of (key, time, features)."""
    n = len(p.features)
    state = "times array<bigint>, flat array<double>"
    out = f"{p.key} {rows.schema[p.key].dataType.simpleString()}, at bigint, x array<array<double>>, m array<array<array<double>>>"
    horizon = (p.memory_days + 1) * DAY + p.m_len * p.step_minutes * 60

    def step(key: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        times, values = (np.array(held.get[0], np.int64), np.array(held.get[1], float).reshape(-1, n)) if held.exists else (np.empty(0, np.int64), np.empty((0, n)))
        newest = times[-1] if len(times) else None
        new = pd.concat(list(frames), ignore_index=True)
        all_times = np.concatenate([times, new["at"].to_numpy(np.int64)])
        all_values = np.concatenate([values, np.array(new["f"].tolist(), float).reshape(-1, n)])
        order = np.argsort(all_times, kind="stable")
        all_times, all_values = all_times[order], all_values[order]
        last = np.r_[all_times[1:] != all_times[:-1], True]
        times, values = all_times[last], all_values[last]
        fresh = np.unique(new["at"].to_numpy(np.int64))
        made = [(at, s) for at in (fresh if newest is None else fresh[fresh > newest]) if (s := _sample(int(at), times, values, p))]
        keep = times > times[-1] - horizon
        held.update((times[keep].tolist(), values[keep].ravel().tolist()))
        if made:
            yield pd.DataFrame({p.key: [key[0]] * len(made), "at": [at for at, _ in made], "x": [x.tolist() for _, (x, _) in made], "m": [m.tolist() for _, (_, m) in made]})

    slim = rows.select(p.key, wall_seconds(F.col(p.time)).alias("at"), assemble(p.features).alias("f"))
    return slim.groupBy(p.key).applyInPandasWithState(step, out, state, "append", "NoTimeout")


def live_step_means(rows: DataFrame, p: Profile, lateness: str = "10 minutes") -> DataFrame:
    """key, time, features: the step means of a stream, as resample.step_means has them, each given out once the watermark
    has passed its step. A watermark needs an instant: the clock's time is taken as UTC's and back, whatever the session's
    zone, so that no clock change moves a step."""
    wall = lambda t: F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.unix_micros(t) / 1_000_000).cast("decimal(18,6)"))
    instant = F.timestamp_micros((wall_seconds(F.col(p.time)) * 1_000_000 + F.extract(F.lit("SECOND"), F.col(p.time)) % 1 * 1_000_000).cast("long"))
    # filters on the instant stay above the watermark, so rows that no step takes still move it on
    d = rows.withColumn("__t", instant).withWatermark("__t", lateness).withColumn(p.time, wall(F.col("__t")))
    step = F.window("__t", f"{p.step_minutes} minutes")
    return on_grid(d, p).groupBy(p.key, step.alias("w")).agg(*feature_means(p)).select(p.key, wall(F.col("w.start")).alias(p.time), *p.features)
