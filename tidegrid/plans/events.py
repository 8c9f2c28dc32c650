"""The events table read as KPI telemetry: an adapter for data that has no KPI logs.

A cell is an event type (its place in the alphabet of types), the features are `value` and the number k in `props`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.datetimes import as_text, snap
from ..operators.resample import fill_gaps, resample, step_means
from ..operators.scaling import scale_by_own_range
from ..operators.timegrid import with_ordinal
from ..profile import EVENT_CELLS, EVENTS


def raw(spark: SparkSession, sf_dir: str, cells: Sequence[int] | None = None) -> DataFrame:
    """event_id, cell, ts, value, k, of all cells or some. Cells are chosen by event type, which the scan can filter by; a
    type that the deployment does not name is no cell."""
    types = list(EVENT_CELLS) if cells is None else [EVENT_CELLS[i] for i in cells]
    d = spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type").isin(types))
    d = d.select("event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return with_ordinal(d, "event_type", EVENT_CELLS).select("event_id", "cell", "ts", "value", "k")


def cells(spark: SparkSession) -> DataFrame:
    return spark.range(len(EVENT_CELLS)).select(F.col("id").cast("int").alias("cell"))


def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return step_means(raw(spark, sf_dir), EVENTS)


def gridded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(raw(spark, sf_dir), EVENTS, cells(spark))


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_gaps(gridded(spark, sf_dir), EVENTS)


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, ts, value, k: on the grid, filled and scaled to [-1, 1] over all cells."""
    return scale_by_own_range(filled(spark, sf_dir), EVENTS)[0]


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, evt_dtm (text), cell, ts: the shape of the key-value source."""
    return raw(spark, sf_dir).select("event_id", as_text(F.col("ts")).alias("evt_dtm"), "cell", "ts", snap(F.col("ts"), EVENTS.step_minutes).alias("slot"))
