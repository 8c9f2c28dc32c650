from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.resample import fill_gaps, resample
from tidegrid.operators.scaling import scale, scale_by_own_range, scale_const, unscale, unscale_vector, value_range
from tidegrid.operators.timegrid import keep_last, spine, with_ordinal
from tidegrid.profile import KPI, KPI_RANGES, Profile

START = datetime(2024, 3, 4)
SMALL = Profile(("a", "b"), step_minutes=60, start_hour=8, end_hour=13, start=START, end=START + timedelta(days=4), x_len=2, memory_days=2)


def test_spine_counts(spark):
    cell = spark.createDataFrame([(0,)], "cell int")
    assert spine(cell, KPI, 10).count() == 262_080
    assert spine(cell, KPI).count() == 8_736


def frame(spark, rows):
    return spark.createDataFrame([(c, t, *v) for c, t, *v in rows], "cell int, ts timestamp_ntz, a double, b double")


def test_keep_last(spark):
    d = spark.createDataFrame([(1, 5, "x"), (1, 7, "y"), (1, 6, "z"), (2, 1, None)], "k int, o int, v string")
    assert sorted(map(tuple, keep_last(d, ["k"], ["o"]).collect())) == [(1, 7, "y"), (2, 1, None)]


def test_ordinal(spark):
    d = spark.createDataFrame([("x",), ("y",), ("?",), (None,)], "n string")
    assert [r["cell"] for r in with_ordinal(d, "n", ["x", "y"]).collect()] == [0, 1, None, None]


def hour(day, h, minute=0, second=0):
    return START + timedelta(days=day, hours=h, minutes=minute, seconds=second)


def test_resample_ignores_nan_and_off_grid(spark):
    rows = [(0, hour(0, 8), 1.0, None), (0, hour(0, 8, 30), 3.0, 4.0), (0, hour(0, 8, 40), float("nan"), 6.0), (0, hour(0, 8, 0, 3), 100.0, 100.0), (0, hour(0, 7), 9.0, 9.0), (0, hour(9, 8), 9.0, 9.0)]
    out = resample(frame(spark, rows), SMALL).orderBy("ts").collect()
    assert len(out) == 20
    assert (out[0]["a"], out[0]["b"]) == (2.0, 5.0)
    assert all(r["a"] is None for r in out[1:])


def test_fill_golden(spark):
    def series(values):
        rows = [(0, hour(d, 8 + h), v, None) for d, day in enumerate(values) for h, v in enumerate(day)]
        return [r["a"] for r in fill_gaps(frame(spark, rows), SMALL).orderBy("ts").collect()]

    n = None
    assert series([[n, 1.0, n, 3.0, n]]) == [1, 1, 1, 3, 3]
    assert series([[n] * 5, [4.0, n, n, n, n]]) == [4] * 10
    assert series([[n, n, n, n, 3.0], [n] * 5, [7.0, n, n, n, n]])[5:10] == [3] * 5
    assert series([[n] * 5]) == [0] * 5


@pytest.mark.parametrize("seed", range(3))
def test_fill_like_pandas(spark, seed):
    rng = np.random.default_rng(seed)
    index = [(c, hour(d, 8 + h)) for c in range(2) for d in range(4) for h in range(5)]
    values = np.where(rng.random((len(index), 2)) < 0.25, rng.random((len(index), 2)).round(3), np.nan)
    table = pd.DataFrame(values, columns=["a", "b"], index=pd.MultiIndex.from_tuples(index, names=["cell", "ts"]))
    in_day = table.groupby([table.index.get_level_values(0), table.index.get_level_values(1).date]).transform(lambda s: s.ffill().bfill())
    want = in_day.groupby(level=0).transform(lambda s: s.ffill().bfill()).fillna(0.0)
    rows = [(c, t, *[None if np.isnan(x) else float(x) for x in v]) for (c, t), v in zip(index, values, strict=True)]
    got = fill_gaps(frame(spark, rows), SMALL).toPandas().set_index(["cell", "ts"]).sort_index()
    assert np.allclose(got[["a", "b"]].to_numpy(), want.sort_index().to_numpy())


def test_scaling(spark):
    d = frame(spark, [(0, hour(0, 8), 1.0, 5.0), (0, hour(0, 9), 3.0, 5.0), (0, hour(0, 10), None, 5.0)])
    done, ranges = scale_by_own_range(d, SMALL)
    assert [(r["a"], r["b"]) for r in done.orderBy("ts").collect()] == [(-1.0, -1.0), (1.0, -1.0), (None, -1.0)]
    assert sorted(map(tuple, ranges.collect())) == [("a", 1.0, 3.0), ("b", 5.0, 5.0)]
    back = unscale(done, ranges, SMALL).orderBy("ts").collect()
    assert [r["a"] for r in back] == [1.0, 3.0, None] and back[0]["b"] == 5.0


def test_const_ranges(spark):
    d = spark.createDataFrame([(-60.5, 10.0), (-121.0, -20.0), (0.0, 0.0)], "rsrp double, rsrq double")
    out = scale_const(d, KPI_RANGES, KPI).collect()
    assert [tuple(r) for r in out] == [(0.0, 2.0), (-1.0, -1.0), (1.0, 1.0)]
    v = unscale_vector(F.array(F.lit(0.0), F.lit(2.0)), KPI_RANGES, ("rsrp", "rsrq"), KPI)
    assert spark.range(1).select(v.alias("v")).first()["v"] == [-60.5, 10.0]


def test_range_skips_nan(spark):
    d = frame(spark, [(0, hour(0, 8), float("nan"), 1.0), (0, hour(0, 9), 2.0, 2.0)])
    assert sorted(map(tuple, value_range(d, ["a"]).collect())) == [("a", 2.0, 2.0)]
    assert scale(d, value_range(d, ["a", "b"]), SMALL).count() == 2


def test_profile_checks():
    with pytest.raises(ValueError):
        Profile(("a", "a"))
    with pytest.raises(ValueError):
        Profile(("a",), step_minutes=7)
    assert KPI.slots_per_day == 156 and KPI.m_len == 11
