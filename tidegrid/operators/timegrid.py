"""Dedup, time spine and alignment of raw rows to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.datetimes import in_hours
from ..profile import Profile


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per keys: the last by order. A map-side combined maximum, so repeated keys are merged before they move."""
    rest = [c for c in df.columns if c not in keys]
    lead = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    last = F.max(F.struct(*lead, F.struct(*rest).alias("row")))
    return df.groupBy(*keys).agg(last.alias("last")).select(*keys, "last.row.*").select(*df.columns)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def with_ordinal(df: DataFrame, name: str, values: Sequence[str], out: str = "cell") -> DataFrame:
    """out = place of df[name] in values (from 0); null where it isn't there."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
    return df.withColumn(out, F.when(at > 0, (at - 1).cast("int")))


def spine(cells: DataFrame, p: Profile, step_seconds: int | None = None) -> DataFrame:
    """key, time: every step of the business hours from p.start to p.end (exclusive), for each row of cells.

    Days are exploded before steps, so no row holds more than a day's array."""
    step = step_seconds or p.step_minutes * 60
    day = F.explode(F.sequence(F.lit(p.start.date()), F.date_sub(F.lit(p.end.date()), 1)))
    first, last = p.start_hour * 3600, p.end_hour * 3600 - 1
    second = F.explode(F.sequence(F.lit(first), F.lit(last), F.lit(step)))
    midnight = F.col("day").cast("timestamp_ntz")
    days = cells.select(p.key, day.alias("day")).select(p.key, "day", second.alias("second"))
    return days.select(p.key, (midnight + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("second").cast("decimal(18,6)"))).alias(p.time))


def on_base_grid(c: Column, seconds: int) -> Column:
    """True for times on a whole multiple of so many seconds in the minute."""
    return F.extract(F.lit("SECOND"), c) % seconds == 0


def align(grid: DataFrame, data: DataFrame, p: Profile) -> DataFrame:
    """The grid with the data at equal times; null where there are none, and data off the grid is dropped."""
    return grid.join(data, [p.key, p.time], "left")


def business_hours(df: DataFrame, p: Profile) -> DataFrame:
    return df.filter(in_hours(F.col(p.time), p.start_hour, p.end_hour))
