"""Forecast errors over all elements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def elements(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """actual and forecast per element. y may be one vector or one for each target step (then the first counts)."""
    first = F.element_at(y, 1) if df.schema[y].dataType.simpleString() == "array<array<double>>" else F.col(y)
    pairs = F.explode(F.arrays_zip(first.alias("actual"), F.col(pred).alias("forecast")))
    return df.select(pairs.alias("e")).select("e.actual", "e.forecast")


def errors(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """One row: n, mse, mae, rse (relative to the deviation from the mean over all elements), mape and smape with the
    number of elements that they are defined on (a zero denominator leaves the element out). One pass: the deviation is
    the variance, which is merged from partitions without a mean known beforehand."""
    e = elements(df, y, pred)
    a, f = F.col("actual"), F.col("forecast")
    relative = F.abs(a - f) / F.nullif(F.abs(a), F.lit(0.0))
    symmetric = 2 * F.abs(a - f) / F.nullif(F.abs(a) + F.abs(f), F.lit(0.0))
    return e.agg(
        F.count(F.lit(1)).alias("n"), F.avg((a - f) * (a - f)).alias("mse"), F.avg(F.abs(a - f)).alias("mae"),
        (F.sqrt(F.sum((a - f) * (a - f))) / F.nullif(F.sqrt(F.var_pop(a) * F.count(a)), F.lit(0.0))).alias("rse"),
        F.avg(relative).alias("mape"), F.count(relative).alias("n_mape"), F.avg(symmetric).alias("smape"), F.count(symmetric).alias("n_smape"),
    )
