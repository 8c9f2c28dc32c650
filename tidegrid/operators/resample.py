"""Step means on the grid, and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.datetimes import snap
from ..profile import Profile
from .timegrid import align, business_hours, on_base_grid, spine


def on_grid(df: DataFrame, p: Profile) -> DataFrame:
    """The rows that a step's mean is made of: in p's time and business hours, on the base grid."""
    rows = business_hours(df, p).filter((F.col(p.time) >= F.lit(str(p.start)).cast("timestamp_ntz")) & (F.col(p.time) < F.lit(str(p.end)).cast("timestamp_ntz")))
    return rows.filter(on_base_grid(F.col(p.time), p.base_seconds)) if p.base_seconds else rows


def feature_means(p: Profile) -> list[Column]:
    """The mean of each feature; NaN counts as missing."""
    return [F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(c) for c in p.features]


def step_means(df: DataFrame, p: Profile) -> DataFrame:
    """Mean of each feature per key and step. Only steps with rows.

    Raw rows are averaged (map-side first) before they meet the grid, so the fine base grid is never built."""
    return on_grid(df, p).groupBy(p.key, snap(F.col(p.time), p.step_minutes).alias(p.time)).agg(*feature_means(p))


def resample(df: DataFrame, p: Profile, cells: DataFrame | None = None) -> DataFrame:
    """Step means on the whole grid; null in empty steps. cells: the keys to lay out, by default those in df."""
    keys = cells if cells is not None else df.select(p.key).distinct()
    return align(spine(keys, p), step_means(df, p), p)


def fill_gaps(df: DataFrame, p: Profile) -> DataFrame:
    """Each feature forward then backward within its day, then forward and backward across days, then 0.

    A step is filled by the nearest earlier value of its day, else the nearest later one of its day, else the nearest
    earlier, else the nearest later one at all: all four are in the last and the next known value, so one exchange and
    one sort by key serve every feature."""
    order = W.partitionBy(p.key).orderBy(p.time)
    before, after = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    known = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.to_date(p.time).alias("d"), F.col(c).cast("double").alias("v")))
    near = df.select(
        p.key, p.time,
        *[F.last(known(c), True).over(before).alias(f"__p_{c}") for c in p.features],
        *[F.first(known(c), True).over(after).alias(f"__n_{c}") for c in p.features],
    )
    day = F.to_date(p.time)

    def filled(c: str):
        a, b = F.col(f"__p_{c}"), F.col(f"__n_{c}")
        return F.coalesce(F.when(a["d"] == day, a["v"]), F.when(b["d"] == day, b["v"]), a["v"], b["v"], F.lit(0.0)).alias(c)

    return near.select(p.key, p.time, *[filled(c) for c in p.features])
