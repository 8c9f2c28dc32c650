"""Whole jobs: preprocess logs, train, evaluate, infer in batches, and advance features step by step.

`python -m tidegrid JOB --help` runs them from a shell.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asof, model, split, train, windows
from ..operators.metrics import errors
from ..operators.resample import fill_gaps, resample
from ..operators.scaling import scale_by_own_range, scale_const, unscale_vector
from ..operators.timegrid import keep_last, union_all, with_ordinal
from ..profile import Profile
from ..sources import files


def preprocess(spark: SparkSession, base: str, keys: Sequence[str], out: str, p: Profile, keep_resampled: bool = False) -> DataFrame:
    """Logs of the keys `STATION_CELL` to the scaled table out/scaled (CSV) and the ranges out/ranges; the cell is the key's
    place in the list. All keys share one plan and one range per feature; files with one header are one scan."""
    logs = files.read_logs_of(spark, base, [tuple(k.split("_", 1)) for k in keys], p)
    named = with_ordinal(logs.withColumn("__key", F.concat_ws("_", "station", "cell_no")), "__key", list(keys), p.key)
    cells = spark.range(len(keys)).select(F.col("id").cast("int").alias(p.key))
    grid = fill_gaps(resample(named.select(p.key, p.time, *p.features), p, cells), p)
    if keep_resampled:
        files.write_table(grid, f"{out}/resampled", p)
        grid = files.read_table(spark, f"{out}/resampled", p)
    scaled, ranges = scale_by_own_range(grid, p)
    files.write_table(scaled, f"{out}/scaled", p)
    files.write_ranges(ranges, f"{out}/ranges")
    return files.read_table(spark, f"{out}/scaled", p)


def dataset(table: DataFrame, p: Profile, cells: Sequence[int] | None = None, how: str = "per_day", seed: int | None = None) -> DataFrame:
    """key, dt, x, y, m, part (train, dev, test) from a scaled table. seed: another choice of dev rows; 0 is a seed too."""
    rows = windows.filter_cells(table, cells, p) if cells is not None else table
    s = files.kept(windows.samples(rows, p, how).select(p.key, "dt", "x", "y", "m"), "samples")
    s = split.by_tail(s, p) if how == "positional" else split.by_time(s, p)
    order = split.mixing_hash(F.lit(0 if seed is None else seed), F.col(p.key), F.dayofyear("dt"), F.hour("dt") * 60 + F.minute("dt"))
    return split.dev_exact(s, p, order)


def fit(spark: SparkSession, table: DataFrame, out: str, p: Profile, cells: Sequence[int] | None = None, seed: int = 0, **settings) -> str:
    """Trains on all of the table's samples; the best weights, the losses and a log go to the day's next folder under out.
    Its path."""
    began = time.perf_counter()
    done = train.train(files.kept(dataset(table, p, cells, seed=seed), "parts"), p, seed=seed, **settings)
    run = files.new_run(spark, out, date.today())
    model.save_weights(spark, done.weights, f"{run}/weights")
    spark.createDataFrame(done.history, "epoch int, train_loss double, dev_loss double").coalesce(1).write.parquet(f"{run}/history")
    files.write_log(spark, run, [f"train cells={cells} seed={seed} {settings}", *[f"epoch {e}: train {a:.6f} dev {b:.6f}" for e, a, b in done.history], f"{time.perf_counter() - began:.1f} s"])
    return run


def evaluate(spark: SparkSession, table: DataFrame, runs: str, out: str, p: Profile, cells: Sequence[int] | None = None) -> DataFrame:
    """Forecasts of the test part with the latest weights, written to out; the row of errors."""
    weights = model.load_weights(spark, f"{files.latest_run(spark, runs)}/weights")
    forecasts = model.predict(dataset(table, p, cells).filter("part = 'test'"), weights, p)
    run = files.new_run(spark, out, date.today())
    files.write_predictions(forecasts, f"{run}/predictions", p)
    found = errors(spark.read.parquet(f"{run}/predictions"))
    files.write_log(spark, run, [f"evaluate cells={cells}", *[f"{k} {v}" for k, v in found.first().asDict().items()]])
    return found


def infer(samples: DataFrame, weights: model.Weights, p: Profile, times: int = 1, partitions: int | None = None) -> DataFrame:
    """Forecasts of samples(x, m), each repeated so many times, over so many partitions."""
    d = split.replicate(samples, times) if times > 1 else samples
    return model.predict(d.repartition(partitions) if partitions else d, weights, p)


@dataclass
class Live:
    """The queues as of a time, kept as tables in the shared folder: a step reads them and its own rows, whatever the number
    of steps before it, and a lost executor costs that step only."""

    rows: DataFrame
    at: str
    p: Profile
    x: DataFrame
    m: DataFrame

    @classmethod
    def start(cls, source: DataFrame, at: str, p: Profile, ranges: dict[str, tuple[float, float]] | None = None, order: Sequence[str] = ()) -> Live:
        """From source(key, time, features). Of rows with one key and time the last by the columns `order` counts (without
        any, that with the greatest features, so that reruns agree)."""
        chosen = [c for c in order if c not in (p.key, p.time, *p.features)]
        rows = keep_last(source.select(p.key, p.time, *p.features, *chosen), [p.key, p.time], [*order] or list(p.features)).drop(*chosen)
        rows = scale_const(rows, ranges, p, "double") if ranges else rows
        m_at = asof.moved(at, p.step_minutes, -1)
        return cls(rows, at, p, files.kept(asof.input_queue(rows, at, p), "inputs"), files.kept(asof.memory_queue(rows, m_at, p), "memory"))

    def advance(self) -> Live:
        """The queues one step later."""
        at = asof.moved(self.at, self.p.step_minutes)
        x = asof.advance_input(self.x, self.rows, at, self.p)
        m = asof.advance_memory(self.m, self.rows, asof.moved(at, self.p.step_minutes, -1), self.p)
        return Live(self.rows, at, self.p, files.kept(x, "inputs"), files.kept(m, "memory"))

    def forecast(self, weights: model.Weights) -> DataFrame:
        """key, at, pred for the step after `at`."""
        return model.predict(asof.pair(self.x, self.m, self.p), weights, self.p).select(self.p.key, F.lit(self.at).alias("at"), "pred")


def near_real_time(source: DataFrame, at: str, weights: model.Weights, p: Profile, ranges: dict[str, tuple[float, float]] | None = None, steps: int = 1, order: Sequence[str] = ()) -> DataFrame:
    """key, at, pred (and value, in the units of `ranges`) for each of the `steps` steps after `at`."""
    live, out = Live.start(source, at, p, ranges, order), []
    for _ in range(steps):
        live = live.advance()
        out.append(live.forecast(weights))
    d = union_all(*out)
    return d.withColumn("value", unscale_vector(F.col("pred"), ranges, p.features, p)) if ranges else d
