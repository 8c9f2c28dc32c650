"""Sliding samples: input x, target y and memory m (the same time of day on earlier days), keyed rows.

Each sampler returns key, dt (time of the first target step), x array<array<double>>, y array<array<double>> and
m array<array<array<double>>> (day, step, feature; oldest day first). One exchange by key serves all windows of a sampler.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.datetimes import wall_seconds
from ..functions.vectors import assemble
from ..profile import Profile

XY = ("x", "y")


def filter_cells(df: DataFrame, ids: Sequence[int], p: Profile) -> DataFrame:
    return df.filter(F.col(p.key).isin(list(ids)))


def _rows(df: DataFrame, p: Profile) -> DataFrame:
    return df.select(p.key, p.time, F.to_date(p.time).alias("day"), assemble(p.features).alias("f"))


def _cut(block: Column, p: Profile) -> tuple[Column, Column]:
    return F.slice(block, 1, F.lit(p.x_len)), F.slice(block, p.x_len + p.foresight + 1, F.lit(p.y_len))


def _memory_day(block: Column, p: Profile) -> Column:
    """x and y steps of a day's block, without the foresight gap."""
    return F.concat(*_cut(block, p)) if p.foresight else block


def positional(df: DataFrame, p: Profile) -> DataFrame:
    """Windows by row position in a key's whole series; they run across nights, and a day back is slots_per_day rows.

    The first sample starts after memory_days * slots_per_day rows, the last ends with the series."""
    order = W.partitionBy(p.key).orderBy(p.time)
    per_day = p.slots_per_day
    d = _rows(df, p).select(
        p.key,
        F.row_number().over(order).alias("seq"),
        F.lead(p.time, p.x_len + p.foresight).over(order).alias("dt"),
        F.collect_list("f").over(order.rowsBetween(0, p.span - 1)).alias("block"),
        F.lead(p.time, p.span - 1).over(order).isNotNull().alias("full"),
        p.time,
    )
    days = [_memory_day(F.lag("block", per_day * (p.memory_days - j)).over(order), p) for j in range(p.memory_days)]
    x, y = _cut(F.col("block"), p)
    d = d.select(p.key, "seq", "dt", "full", x.alias("x"), y.alias("y"), F.array(*days).alias("m"))
    return d.filter(F.col("full") & (F.col("seq") > per_day * p.memory_days)).drop("full")


def windows(df: DataFrame, p: Profile) -> DataFrame:
    """x and y inside each day: key, day, slot (place of x in the day, from 1), dt, x, y."""
    order = W.partitionBy(p.key, "day").orderBy(p.time)
    d = _rows(df, p).repartition(p.key).select(
        p.key, "day",
        F.row_number().over(order).alias("slot"),
        F.lead(p.time, p.x_len + p.foresight).over(order).alias("dt"),
        F.collect_list("f").over(order.rowsBetween(0, p.span - 1)).alias("block"),
        F.lead(p.time, p.span - 1).over(order).isNotNull().alias("full"),
    )
    x, y = _cut(F.col("block"), p)
    return d.filter("full").select(p.key, "day", "slot", "dt", x.alias("x"), y.alias("y"), "block")


def per_day(df: DataFrame, p: Profile, first_day: int | None = None) -> DataFrame:
    """Windows inside each day, with the same slot of the memory_days days before (days that are present).

    first_day: place of the first sampled day among a key's days, from 0; by default memory_days + 1."""
    first = p.memory_days + 1 if first_day is None else first_day
    by_slot = W.partitionBy(p.key, "slot").orderBy("day")
    by_day = W.partitionBy(p.key).orderBy("day")
    d = windows(df, p).withColumn("nth", F.dense_rank().over(by_day))
    back = by_slot.rowsBetween(-p.memory_days, -1)
    d = d.withColumn("m", F.collect_list(_memory_day(F.col("block"), p)).over(back)).withColumn("days", F.count(F.lit(1)).over(back))
    return d.filter((F.col("days") == p.memory_days) & (F.col("nth") > first)).select(p.key, "day", "slot", "dt", "x", "y", "m")


def by_time(df: DataFrame, p: Profile) -> DataFrame:
    """Windows of strictly consecutive steps, with the same time on exactly the memory_days calendar days before; a
    sample with a gap in any of them is left out."""
    order = W.partitionBy(p.key).orderBy(p.time)
    d = _rows(df, p).select(
        p.key, "day", p.time,
        F.lead(p.time, p.x_len + p.foresight).over(order).alias("dt"),
        F.lead(p.time, p.span - 1).over(order).alias("last"),
        F.collect_list("f").over(order.rowsBetween(0, p.span - 1)).alias("block"),
    )
    gapless = wall_seconds(F.col("last")) - wall_seconds(F.col(p.time)) == (p.span - 1) * p.step_minutes * 60
    d = d.filter(gapless).withColumn("at", F.date_format(p.time, "HHmmss")).withColumn("day_number", F.unix_date("day"))
    same_time = W.partitionBy(p.key, "at").orderBy("day_number").rangeBetween(-p.memory_days, -1)
    d = d.withColumn("m", F.collect_list(_memory_day(F.col("block"), p)).over(same_time)).withColumn("days", F.count(F.lit(1)).over(same_time)).filter(F.col("days") == p.memory_days)
    x, y = _cut(F.col("block"), p)
    return d.select(p.key, "dt", x.alias("x"), y.alias("y"), "m")


def samples(df: DataFrame, p: Profile, how: str = "per_day", **settings) -> DataFrame:
    kinds = {"per_day": per_day, "positional": positional, "by_time": by_time}
    if how not in kinds:
        raise ValueError(f"how must be one of {sorted(kinds)}")
    return kinds[how](df, p, **settings)


def long_form(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """An array column (of vectors, or of days of vectors) as rows: keys, (day,) step, feature, value, counted from 0."""
    nested = df.schema[column].dataType.simpleString().count("array<") == 3
    d = df.select(*keys, F.col(column).alias("a"))
    if nested:
        d = d.select(*keys, F.posexplode("a").alias("day", "a"))
    lead = [*keys, *(["day"] if nested else [])]
    d = d.select(*lead, F.posexplode("a").alias("step", "a"))
    return d.select(*lead, "step", F.posexplode("a").alias("feature", "value"))


def last_days_series(df: DataFrame, p: Profile, days: int | None = None) -> DataFrame:
    """key and series: each key's vectors of the last days (by default test_days) of the whole table, in time order."""
    end = df.agg(F.to_date(F.max(p.time)).alias("end"))
    n = days or p.test_days
    recent = _rows(df, p).crossJoin(F.broadcast(end)).filter((F.col("day") > F.date_sub("end", n)) & (F.col("day") <= F.col("end")))
    return recent.groupBy(p.key).agg(F.transform(F.array_sort(F.collect_list(F.struct(p.time, "f"))), lambda s: s["f"]).alias("series"))
