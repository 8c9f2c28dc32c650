"""Features as of a time: per-key queues of the last steps and of the same steps on earlier days, advanced by one step.

Times are text, yyyyMMddHHmmss. A queue is a row: key, queue array<array<double>> (inputs), or key, days
array<array<array<double>>> (memory, oldest day first). Queues are built from the times a key has; incomplete ones are
left out. Rows that repeat a key and time must be merged before (timegrid.keep_last).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.datetimes import time_filter
from ..functions.vectors import assemble
from ..profile import Profile

_FORMAT = "%Y%m%d%H%M%S"


def moved(text: str, minutes: int = 0, days: int = 0) -> str:
    return (datetime.strptime(text, _FORMAT) + timedelta(minutes=minutes, days=days)).strftime(_FORMAT)


def _at(df: DataFrame, until: str, minutes: int, days: int, p: Profile) -> DataFrame:
    return df.filter(time_filter(F.col(p.time), until, minutes, days)).select(p.key, p.time, assemble(p.features).alias("f"))


def _sequence(rows: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(rows)), lambda s: s["f"])


def input_queue(df: DataFrame, until: str, p: Profile) -> DataFrame:
    """The x_len steps that end at `until`."""
    rows = _at(df, until, (p.x_len - 1) * p.step_minutes, 1, p)
    return rows.groupBy(p.key).agg(_sequence(F.struct(p.time, "f")).alias("queue")).filter(F.size("queue") == p.x_len)


def memory_queue(df: DataFrame, until: str, p: Profile) -> DataFrame:
    """On `until` and the memory_days - 1 days before, the m_len steps that end at its time of day."""
    rows = _at(df, until, (p.m_len - 1) * p.step_minutes, p.memory_days, p)
    # ranges may cross midnight: a row belongs to the day on which its range ends
    shift = int((datetime.strptime(until, _FORMAT) - datetime.strptime(until[:8] + "000000", _FORMAT)).total_seconds())
    day = F.to_date(F.col(p.time) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(86_399 - shift).cast("decimal(18,6)")))
    by_day = rows.groupBy(p.key, day.alias("day")).agg(_sequence(F.struct(p.time, "f")).alias("f")).filter(F.size("f") == p.m_len)
    return by_day.groupBy(p.key).agg(_sequence(F.struct("day", "f")).alias("days")).filter(F.size("days") == p.memory_days)


def advance_input(queue: DataFrame, df: DataFrame, at: str, p: Profile, on_missing: str = "drop") -> DataFrame:
    """The queue without its first step and with the one at `at`. on_missing: keys without a new step are dropped, or
    kept as they are (`stale`)."""
    new = _at(df, at, 0, 1, p).select(p.key, F.col("f").alias("new"))
    joined = queue.join(new, p.key, "inner" if on_missing == "drop" else "left")
    moved_on = F.concat(F.slice("queue", 2, F.lit(p.x_len - 1)), F.array("new"))
    return joined.select(p.key, F.when(F.col("new").isNull(), F.col("queue")).otherwise(moved_on).alias("queue"))


def advance_memory(queue: DataFrame, df: DataFrame, at: str, p: Profile, on_missing: str = "drop") -> DataFrame:
    """Each day without its first step and with the one at the time of `at`, on `at` and the days before."""
    rows = _at(df, at, 0, p.memory_days, p)
    new = rows.groupBy(p.key).agg(_sequence(F.struct(p.time, "f")).alias("new")).filter(F.size("new") == p.memory_days)
    joined = queue.join(new, p.key, "inner" if on_missing == "drop" else "left")
    moved_on = F.zip_with("days", "new", lambda d, n: F.concat(F.slice(d, 2, F.lit(p.m_len - 1)), F.array(n)))
    return joined.select(p.key, F.when(F.col("new").isNull(), F.col("days")).otherwise(moved_on).alias("days"))


def pair(inputs: DataFrame, memory: DataFrame, p: Profile) -> DataFrame:
    """key, x, m for keys that have both."""
    return inputs.join(memory, p.key).select(p.key, F.col("queue").alias("x"), F.col("days").alias("m"))


def unpaired(inputs: DataFrame, memory: DataFrame, p: Profile) -> DataFrame:
    """Keys with inputs but no memory, for the audit."""
    return inputs.join(memory, p.key, "left_anti").select(p.key)


def features_at(df: DataFrame, at: str, p: Profile) -> DataFrame:
    """key, x, m for a forecast of the step after `at`: x ends at `at`, memory at the next step's time of day."""
    return pair(input_queue(df, at, p), memory_queue(df, moved(at, p.step_minutes, -1), p), p)
