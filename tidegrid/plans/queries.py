"""Registered time-series queries over the events adapter, and the same in DuckDB SQL (plans/oracle.py)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.datetimes import as_text, before_days, in_steps, move_minutes, parse_text, snap, text_time_filter, time_filter
from ..operators import asof, metrics, model, scaling, split, timegrid, train, windows
from ..profile import EVENT_CELLS, EVENTS, KPI_RANGES, Profile
from ..sources import files, kv
from ..streaming.queues import live_features, live_step_means
from . import events as ev
from .oracle import SQL

__all__ = ["QUERIES", "SQL"]

P = EVENTS
HIDDEN = 4
UNTIL, AT = "20240120120000", "20240120140000"


def _r(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded, and zero without a sign, for comparison with another engine."""
    return df.withColumns({c: F.when(F.round(c, 6) == 0, F.lit(0.0)).otherwise(F.round(c, 6)) for c in columns})


def time_filter_days(spark, d):
    """Closed ranges on each of three days, on text as the key-value source has it and on time for the file scan."""
    rows = ev.kv(spark, d).filter(time_filter(F.col("ts"), UNTIL, 45, 3) & text_time_filter(F.col("evt_dtm"), UNTIL, 45, 3))
    return rows.select("event_id", "evt_dtm", "cell")


def time_filter_exact(spark, d):
    """Steps that start at one time on seven days: by text, and by ranges of the raw time for the scan."""
    rows = ev.kv(spark, d).filter(in_steps(F.col("ts"), UNTIL, P.step_minutes, 7)).withColumn("slot_dtm", F.date_format("slot", "yyyyMMddHHmmss"))
    return rows.filter(text_time_filter(F.col("slot_dtm"), UNTIL, 0, 7)).select("event_id", "slot_dtm", "cell")


def text_times(spark, d):
    e = F.col("evt_dtm")
    return ev.kv(spark, d).select("event_id", parse_text(e).alias("parsed"), move_minutes(e, 7).alias("later"), move_minutes(e, -90).alias("earlier"), before_days(e, 30).alias("days_before"))


def cell_in_filter(spark, d):
    return windows.filter_cells(ev.raw(spark, d, [1, 3]), [1, 3], P).select("event_id", "cell", "value")


def cell_ordinal(spark, d):
    return ev.raw(spark, d).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def dedup_last(spark, d):
    rows = ev.raw(spark, d).withColumn("ts", snap(F.col("ts"), P.step_minutes))
    return timegrid.keep_last(rows, ["cell", "ts"], ["event_id"])


def union_rows(spark, d):
    """All cells in two frames, and the high values again."""
    r = ev.raw(spark, d)
    return timegrid.union_all(r.filter("cell < 2"), r.filter("cell >= 2"), r.filter("value > 50")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def spine_hours(spark, d):
    return timegrid.spine(ev.cells(spark), P)


def spine_fine(spark, d):
    """The ten-second base grid."""
    return timegrid.spine(ev.cells(spark), P, 10)


def spine_left_join(spark, d):
    hours = ev.raw(spark, d).select("cell", snap(F.col("ts"), P.step_minutes).alias("ts"), "event_id", "value")
    return timegrid.align(timegrid.spine(ev.cells(spark), P), hours, P).fillna(-1, ["event_id"])


def resample_mean(spark, d):
    return _r(ev.gridded(spark, d), "value", "k")


def gap_fill(spark, d):
    return _r(ev.filled(spark, d), "value", "k")


def min_max_range(spark, d):
    return _r(scaling.value_range(ev.filled(spark, d), P.features), "min", "max")


def scale_global(spark, d):
    return _r(ev.scaled(spark, d), "value", "k")


def scale_const(spark, d):
    """Online scaling by fixed ranges: value as rsrp, k as dl_prb_usage_rate."""
    ranges = {"value": KPI_RANGES["rsrp"], "k": KPI_RANGES["dl_prb_usage_rate"]}
    return _r(scaling.scale_const(ev.raw(spark, d), ranges, P, "double").select("event_id", "value", "k"), "value", "k")


def unscale(spark, d):
    filled = ev.filled(spark, d)
    done, ranges = scaling.scale_by_own_range(filled, P)
    return _r(scaling.unscale(done, ranges, P), "value", "k")


def unscale_vectors(spark, d):
    ranges = {"value": (10.0, 30.0), "k": (-5.0, 5.0)}
    v = scaling.unscale_vector(F.array("value", "k"), ranges, P.features, P)
    out = ev.scaled(spark, d).select("cell", "ts", v.alias("v"))
    return _r(out.select("cell", "ts", F.element_at("v", 1).alias("value"), F.element_at("v", 2).alias("k")), "value", "k")


def _long(df: DataFrame, column: str) -> DataFrame:
    return _r(windows.long_form(df, ["cell", "dt"], column), "value")


def windows_positional(spark, d):
    return _long(windows.positional(ev.scaled(spark, d), P), "x")


def targets_positional(spark, d):
    return _long(windows.positional(ev.scaled(spark, d), P), "y")


def memory_positional(spark, d):
    return _long(windows.positional(ev.scaled(spark, d), P), "m")


def windows_per_day(spark, d):
    w = windows.windows(ev.scaled(spark, d), P)
    return _r(windows.long_form(w, ["cell", "slot", "dt"], "x"), "value")


def targets_per_day(spark, d):
    w = windows.windows(ev.scaled(spark, d), P)
    return _r(windows.long_form(w, ["cell", "slot", "dt"], "y"), "value")


def windows_foresight(spark, d):
    """Targets two steps after the input ends."""
    far = Profile(**{**P.__dict__, "foresight": 2})
    return _r(windows.long_form(windows.windows(ev.scaled(spark, d), far), ["cell", "slot", "dt"], "y"), "value")


def memory_per_day(spark, d):
    return _long(windows.per_day(ev.scaled(spark, d), P), "m")


def memory_by_time(spark, d):
    """Samples of the steps that had rows, gaps left out, memory on exact calendar days."""
    return _long(windows.by_time(ev.means(spark, d), P), "m")


def last_days_tensor(spark, d):
    s = windows.last_days_series(ev.scaled(spark, d), P)
    return _r(windows.long_form(s, ["cell"], "series"), "value")


def _samples(spark, d):
    return windows.per_day(ev.scaled(spark, d), P).select("cell", "dt", "x", "y", "m")


def split_time(spark, d):
    return split.by_time(_samples(spark, d).select("cell", "dt"), P).groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


def split_tail(spark, d):
    s = split.by_tail(windows.positional(ev.scaled(spark, d), P), P)
    return s.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"), F.min("dt").alias("first"), F.max("dt").alias("last"))


def _parts(spark, d):
    s = split.by_time(files.kept(_samples(spark, d), "samples"), P)
    return split.dev_exact(s, P, split.mixing_hash(F.col("cell"), F.dayofyear("dt"), F.hour("dt")))


def split_dev_exact(spark, d):
    return _parts(spark, d).select("cell", "dt", "part")


def ar_head(spark, d):
    w = model.fixed_weights(P, HIDDEN)
    a = _samples(spark, d).select("cell", "dt", F.posexplode(model.ar_head(F.col("x"), w.x_w, w.x_b)).alias("feature", "value"))
    return _r(a, "value")


def _forecasts(spark, d, how=model.predict):
    return how(_samples(spark, d), model.fixed_weights(P, HIDDEN), P)


def predict(spark, d):
    out = _forecasts(spark, d).select("cell", "dt", F.posexplode("pred").alias("feature", "value"))
    return _r(out, "value")


def predict_native(spark, d):
    out = _forecasts(spark, d, model.predict_native).select("cell", "dt", F.posexplode("pred").alias("feature", "value"))
    return _r(out, "value")


def forecast_errors(spark, d):
    return _r(metrics.errors(_forecasts(spark, d)), "mse", "mae", "rse", "mape", "smape")


def amplify(spark, d):
    return split.replicate(ev.raw(spark, d).select("event_id"), 3)


def _online(spark, d):
    return ev.filled(spark, d)


def asof_inputs(spark, d):
    q = asof.input_queue(_online(spark, d), AT, P)
    return _r(windows.long_form(q, ["cell"], "queue"), "value")


def asof_memory(spark, d):
    q = asof.memory_queue(_online(spark, d), asof.moved(AT, P.step_minutes, -1), P)
    return _r(windows.long_form(q, ["cell"], "days"), "value")


def queue_advance(spark, d):
    """Queues of one step before, advanced: equal to those of the step itself."""
    rows = _online(spark, d)
    q = asof.advance_input(asof.input_queue(rows, asof.moved(AT, -P.step_minutes), P), rows, AT, P)
    return _r(windows.long_form(q, ["cell"], "queue"), "value")


def memory_advance(spark, d):
    rows, next_at = _online(spark, d), asof.moved(AT, P.step_minutes, -1)
    q = asof.advance_memory(asof.memory_queue(rows, asof.moved(next_at, -P.step_minutes), P), rows, next_at, P)
    return _r(windows.long_form(q, ["cell"], "days"), "value")


def asof_pairs(spark, d):
    """Everything that the forecasts at a time are made from, for the cells that have it: x as day -1, then the memory days."""
    q = asof.features_at(files.kept(_online(spark, d), "online"), AT, P)
    x = windows.long_form(q, ["cell"], "x").select("cell", F.lit(-1).alias("day"), "step", "feature", "value")
    return _r(x.unionByName(windows.long_form(q, ["cell"], "m")), "value")


def table_round_trip(spark, d):
    """The scaled grid written as CSV in table order and read back with its fixed schema of 32-bit floats."""
    path = files.scratch(spark, "table")
    files.write_table(ev.scaled(spark, d), path, P)
    return files.read_table(spark, path, P).select("cell", "ts", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in P.features])


def ranges_round_trip(spark, d):
    path = files.scratch(spark, "ranges")
    files.write_ranges(scaling.value_range(ev.filled(spark, d), P.features), path)
    return _r(files.read_ranges(spark, path), "min", "max")


def weights_round_trip(spark, d):
    """Forecasts with weights that were saved and restored."""
    path = files.scratch(spark, "weights")
    model.save_weights(spark, model.fixed_weights(P, HIDDEN), path)
    out = model.predict(_samples(spark, d), model.load_weights(spark, path), P)
    return _r(out.select("cell", "dt", F.posexplode("pred").alias("feature", "value")), "value")


def predictions_round_trip(spark, d):
    path = files.scratch(spark, "predictions")
    files.write_predictions(_forecasts(spark, d), path, P)
    return _r(spark.read.parquet(path).select("cell", "dt", F.posexplode("pred").alias("feature", "value")), "value")


def latest_run_folder(spark, d):
    """A run for each cell, on the day of its last event: the folder of the latest one."""
    base = files.scratch(spark, "runs")
    for (day,) in ev.raw(spark, d).groupBy("cell").agg(F.max(F.to_date("ts")).alias("day")).select("day").collect():
        files.new_run(spark, base, day)
    return spark.createDataFrame([(files.latest_run(spark, base).rpartition("/")[2],)], "run string")


def stream_features(spark, d):
    """The as-of features of every step of the filled grid, made by the stateful stream: x as day -1, then the memory days."""
    path = files.scratch(spark, "stream")
    grid = ev.filled(spark, d)
    grid.write.parquet(f"{path}/in")
    live = live_features(spark.readStream.schema(grid.schema).parquet(f"{path}/in"), P)
    q = live.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    x = windows.long_form(out, ["cell", "at"], "x").select("cell", "at", F.lit(-1).alias("day"), "step", "feature", "value")
    return _r(x.unionByName(windows.long_form(out, ["cell", "at"], "m")), "value")


def stream_means(spark, d):
    """Step means as a stream gives them out: those that the watermark has passed when the input ends."""
    path = files.scratch(spark, "means")
    rows = ev.raw(spark, d).select("cell", "ts", *P.features)
    rows.write.parquet(f"{path}/in")
    live = live_step_means(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), P)
    q = live.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    q.awaitTermination()
    return _r(spark.read.parquet(f"{path}/out"), *P.features)


def logs_by_name(spark, d):
    """Raw rows as CSV logs, two files a cell with their columns in different order, read back by name; of rows with one
    time the last of the later file stays."""
    path = files.scratch(spark, "logs")
    rows = ev.raw(spark, d).select("event_id", "cell", as_text(F.col("ts")).alias("EVT_DTM"), F.col("value").alias("VALUE"), F.col("k").alias("K"))
    for half, columns in (("a", ["EVT_DTM", "VALUE", "K"]), ("b", ["K", "EVT_DTM", "VALUE"])):
        own = rows.filter(F.col("event_id") % 2 == int(half == "b")).repartition("cell").sortWithinPartitions("cell", "event_id")
        own.select("cell", *columns).write.partitionBy("cell").option("header", True).csv(f"{path}/{half}")
        files.collect_logs(spark, f"{path}/{half}", "cell", path, "7", half)
    p = Profile(**{**P.__dict__, "features": ("value", "k")})
    return files.read_logs_of(spark, path, [("7", str(c)) for c in range(len(EVENT_CELLS))], p).select("station", "cell_no", "ts", "value", "k")


def indexed_table(spark, d):
    """The scaled grid written as CSV and read back with its first column as an index of text."""
    path = files.scratch(spark, "indexed")
    files.write_table(ev.scaled(spark, d), path, P)
    return files.read_indexed(spark, path, P).select("cell", "ts", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in P.features])


def kv_scan(spark, d):
    """Raw rows as groups of the key-value store, scanned."""
    path = files.scratch(spark, "kv")
    rows = ev.kv(spark, d).join(ev.raw(spark, d).select("event_id", "value", "k"), "event_id")
    groups = rows.select(as_text(F.col("slot")).alias("evt_dtm"), F.col("event_id").cast("int").alias("uniq_id"), F.col("value").alias("rsrp"), F.col("k").alias("cqi"), (F.col("event_id") % 2).cast("int").alias("random"))
    kv.write_groups(groups, path)
    kv.register(spark)
    got = spark.read.format("kvtable").option("path", path).load()
    return got.select("evt_dtm", "uniq_id", *[F.round(F.col(c).cast("double"), 3).alias(c) for c in ("rsrp", "cqi")])


def npy_round_trip(spark, d):
    """Each cell's scaled series as one .npy file, scanned."""
    path = files.scratch(spark, "npy")
    series = ev.scaled(spark, d).select("cell", "ts", F.array("value", "k").alias("v"))
    files.write_npy(series, path, "cell", "ts", "v")
    got = files.read_npy(spark, path)
    cell = F.regexp_extract("path", r"(\d+)\.npy$", 1).cast("int").alias("cell")
    return got.select(cell, F.col("at").cast("long").alias("at"), *[F.round(F.element_at("value", i), 4).alias(c) for i, c in ((1, "value"), (2, "k"))])


def samples_replicated(spark, d):
    """Samples written twice each, read back."""
    path = files.scratch(spark, "samples")
    files.write_samples(_samples(spark, d), path, 2)
    return _r(windows.long_form(spark.read.parquet(path), ["cell", "dt", "copy"], "x"), "value")


def text_predictions(spark, d):
    """Forecasts written as lines of text, read back."""
    path = files.scratch(spark, "lines")
    files.write_predictions(_forecasts(spark, d), path, P, "text")
    got = spark.read.text(path).select(F.from_json("value", "cell int, dt timestamp_ntz, pred array<double>").alias("v"))
    return _r(got.select("v.cell", "v.dt", F.posexplode("v.pred").alias("feature", "value")), "value")


def train_history(spark, d):
    """Losses of a short training run on all samples; no SQL form."""
    done = train.train(_parts(spark, d), P, HIDDEN, epochs=3)
    return spark.createDataFrame(done.history, "epoch int, train_loss double, dev_loss double")


_LIST = (
    time_filter_days, time_filter_exact, text_times, cell_in_filter, cell_ordinal, dedup_last, union_rows, spine_hours, spine_fine, spine_left_join,
    resample_mean, gap_fill, min_max_range, scale_global, scale_const, unscale, unscale_vectors, windows_positional, targets_positional, memory_positional,
    windows_per_day, targets_per_day, windows_foresight, memory_per_day, memory_by_time, last_days_tensor, split_time, split_tail, split_dev_exact,
    ar_head, predict, predict_native, forecast_errors, amplify, asof_inputs, asof_memory, queue_advance, memory_advance, asof_pairs,
    logs_by_name, indexed_table, kv_scan, npy_round_trip, samples_replicated, text_predictions, table_round_trip, ranges_round_trip, weights_round_trip, predictions_round_trip, latest_run_folder, stream_features, stream_means, train_history,
)
QUERIES = {f.__name__: f for f in _LIST}
