"""Min-max scaling: ranges as data, forward and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..profile import Profile


def value_range(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, min, max over all rows, NaN apart: one aggregate of one row, then unpivoted."""
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    wide = df.agg(*[F.struct(F.min(clean(c)).alias("min"), F.max(clean(c)).alias("max")).alias(c) for c in features])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`.min").alias("min"), F.col(f"`{c}`.max").alias("max")) for c in features]))
    return wide.select(rows.alias("r")).select("r.*")


def _forward(v: Column, lo: Column, hi: Column, p: Profile) -> Column:
    """A constant feature becomes the lower bound; nothing is clamped."""
    share = F.coalesce((v - lo) * F.lit(p.high - p.low) / F.nullif(hi - lo, F.lit(0.0)), F.when(v.isNotNull(), F.lit(0.0)))
    return share + F.lit(p.low)


def _back(v: Column, lo: Column, hi: Column, p: Profile) -> Column:
    return (v - F.lit(p.low)) * (hi - lo) / F.lit(p.high - p.low) + lo


def _wide(ranges: DataFrame, features: Sequence[str]) -> DataFrame:
    """The ranges as one row."""
    pick = lambda c, what: F.max(F.when(F.col("feature") == c, F.col(what))).alias(f"__{c}_{what}")
    return ranges.agg(*[pick(c, what) for c in features for what in ("min", "max")])


def _apply(df: DataFrame, ranges: DataFrame, features: Sequence[str], p: Profile, how) -> DataFrame:
    joined = df.crossJoin(F.broadcast(_wide(ranges, features)))  # one row, so it stays lazy and needs no collect
    new = {c: how(F.col(c).cast("double"), F.col(f"__{c}_min"), F.col(f"__{c}_max"), p).alias(c) for c in features}
    return joined.select(*[new.get(c, F.col(c)) for c in df.columns])


def scale(df: DataFrame, ranges: DataFrame, p: Profile) -> DataFrame:
    """Features by name to [low, high] of the given ranges; other columns as they are."""
    return _apply(df, ranges, p.features, p, _forward)


def unscale(df: DataFrame, ranges: DataFrame, p: Profile) -> DataFrame:
    return _apply(df, ranges, p.features, p, _back)


def scale_by_own_range(df: DataFrame, p: Profile) -> tuple[DataFrame, DataFrame]:
    """(scaled, ranges)."""
    ranges = value_range(df, p.features)
    return scale(df, ranges, p), ranges


def scale_const(df: DataFrame, ranges: Mapping[str, tuple[float, float]], p: Profile, kind: str = "float") -> DataFrame:
    """Scaling by fixed ranges in one projection, as a stream needs it; results are cast to `kind`."""
    new = {c: _forward(F.col(c).cast("double"), F.lit(lo), F.lit(hi), p).cast(kind).alias(c) for c, (lo, hi) in ranges.items() if c in df.columns}
    return df.select(*[new.get(c, F.col(c)) for c in df.columns])


def unscale_vector(vector: Column, ranges: Mapping[str, tuple[float, float]], features: Sequence[str], p: Profile) -> Column:
    """A vector in feature order back to its ranges."""
    lo, hi = (F.array(*[F.lit(ranges[c][k]) for c in features]) for k in (0, 1))
    return F.transform(F.arrays_zip(vector.alias("v"), lo.alias("lo"), hi.alias("hi")), lambda s: _back(s["v"], s["lo"], s["hi"], p))
