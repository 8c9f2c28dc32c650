"""Train, dev and test sets, and row replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..profile import Profile


def by_time(samples: DataFrame, p: Profile) -> DataFrame:
    """+ part: `test` for samples later than the last one minus test_days, else `train`."""
    end = samples.agg(F.max("dt").alias("end"))
    late = F.col("dt") > F.col("end") - F.make_dt_interval(F.lit(p.test_days))
    return samples.crossJoin(F.broadcast(end)).withColumn("part", F.when(late, "test").otherwise("train")).drop("end")


def by_tail(samples: DataFrame, p: Profile, rows: int | None = None) -> DataFrame:
    """+ part: `test` for each key's last samples, by default test_days * slots_per_day - x_len of them."""
    n = rows if rows is not None else p.test_days * p.slots_per_day - p.x_len
    place = F.row_number().over(W.partitionBy(p.key).orderBy(F.desc("dt")))
    return samples.withColumn("part", F.when(place <= n, "test").otherwise("train"))


def mixing_hash(*keys: Column) -> Column:
    """A number below 2^32 from integer keys, by arithmetic that any SQL engine has."""
    out = F.lit(0).cast("long")
    for k in keys:
        out = ((out * 31 + k.cast("long")) % (1 << 20) * 2654435761 + 40503) % (1 << 32)
    return out


def dev_exact(samples: DataFrame, p: Profile, order: Column, ties: str = "dt", slices: int = 4096) -> DataFrame:
    """`train` rows become `dev` for floor(dev_ratio * their number) of them: the first by order, ties by key and dt,
    which tell samples apart. order must be a number below 2^32.

    The cut is one row (order, key, dt), found on those columns alone: by counts of `slices` parts of the order, and a
    rank in the one part that holds it. The samples themselves are compared with that row, and so neither sorted nor
    moved."""
    place = F.struct(order.alias("h"), F.col(p.key).alias("k"), F.col(ties).alias("t"))
    train = samples.filter(F.col("part") == "train").select(place.alias("at")).withColumn("s", (F.col("at.h") * slices / (1 << 32)).cast("int"))
    before = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    counts = train.groupBy("s").agg(F.count(F.lit(1)).alias("n"))  # `slices` rows at most
    counts = counts.select("s", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.floor(F.sum("n").over(W.partitionBy(F.lit(1))) * F.lit(p.dev_ratio)).alias("take"))
    held = counts.filter("before < take AND take <= before + n").select("s", (F.col("take") - F.col("before")).alias("rank"))
    ranked = train.join(F.broadcast(held), "s").withColumn("r", F.row_number().over(W.partitionBy("s").orderBy("at")))
    cut = ranked.filter("r = rank").agg(F.max("at").alias("__cut"))  # null: none
    dev = (F.col("part") == "train") & (place <= F.col("__cut"))
    return samples.crossJoin(F.broadcast(cut)).withColumn("part", F.when(dev, "dev").otherwise(F.col("part"))).select(*samples.columns)


def replicate(df: DataFrame, times: int) -> DataFrame:
    """Each row so many times, copy counted from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
