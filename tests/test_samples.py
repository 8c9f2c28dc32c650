from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import split, windows
from tidegrid.operators.timegrid import spine
from tidegrid.profile import KPI, Profile

P = Profile(("a", "b"), step_minutes=60, start_hour=8, end_hour=14, start=datetime(2024, 3, 4), end=datetime(2024, 3, 9), x_len=2, memory_days=2)


def full(spark, p, cells=1):
    d = spine(spark.range(cells).select(F.col("id").cast("int").alias("cell")), p)
    return d.select("cell", "ts", *[(F.unix_date(F.to_date("ts")) * 100 + F.hour("ts") + F.minute("ts") / 60 + F.col("cell") * 0.001 + i).cast("double").alias(c) for i, c in enumerate(p.features)])


@pytest.fixture(scope="module")
def kpi(spark):
    return full(spark, KPI).cache()


def test_full_counts(spark, kpi):
    s = split.by_tail(windows.positional(kpi, KPI).select("cell", "dt"), KPI)
    s = split.dev_exact(s, KPI, split.mixing_hash(F.dayofyear("dt"), F.hour("dt"), F.minute("dt")))
    assert dict(s.groupBy("part").count().collect()) == {"test": 1082, "dev": 655, "train": 5897}
    s = split.by_time(windows.per_day(kpi, KPI).select("cell", "dt"), KPI)
    s = split.dev_exact(s, KPI, split.mixing_hash(F.dayofyear("dt"), F.hour("dt"), F.minute("dt")))
    assert dict(s.groupBy("part").count().collect()) == {"test": 1022, "dev": 598, "train": 5388}
    first = windows.positional(kpi, KPI).orderBy("seq").first()
    assert first["seq"] == 7 * 156 + 1


def brute(values, times, p, how):
    """Samples of one series of complete days, by indexing."""
    n, day, out = len(values), p.slots_per_day, {}
    for s in range(n):
        if how == "positional":
            if s < day * p.memory_days or s + p.span > n:
                continue
        elif s // day < p.memory_days + 1 or s % day + p.span > day:
            continue
        cut = lambda i: np.concatenate([values[i : i + p.x_len], values[i + p.x_len + p.foresight : i + p.span]])
        out[times[s + p.x_len + p.foresight]] = (values[s : s + p.x_len], values[s + p.x_len + p.foresight : s + p.span], [cut(s - day * j) for j in range(p.memory_days, 0, -1)])
    return out


@pytest.mark.parametrize("how", ["positional", "per_day"])
@pytest.mark.parametrize("foresight,y_len", [(0, 1), (1, 2)])
def test_like_brute_force(spark, how, foresight, y_len):
    p = Profile(**{**P.__dict__, "foresight": foresight, "y_len": y_len})
    d = full(spark, p, 2)
    got = windows.samples(d, p, how).toPandas()
    for c, table in d.toPandas().sort_values("ts").groupby("cell"):
        want = brute(table[["a", "b"]].to_numpy(), table["ts"].tolist(), p, how)
        ours = {r.dt: r for r in got[got["cell"] == c].itertuples()}
        assert set(ours) == set(want) and want
        for t, (x, y, m) in want.items():
            as_array = lambda v: np.array([[list(i) for i in j] if hasattr(j[0], "__len__") else list(j) for j in v])
            assert np.allclose(as_array(ours[t].x), x) and np.allclose(as_array(ours[t].y), y) and np.allclose(as_array(ours[t].m), np.array(m))


def test_by_time_equals_per_day_without_gaps(spark):
    d = full(spark, P)
    a = windows.per_day(d, P, first_day=P.memory_days).select("cell", "dt", "x", "y", "m")
    b = windows.by_time(d, P).select("cell", "dt", "x", "y", "m")
    assert a.count() == 12 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_by_time_leaves_gaps_out(spark):
    d = full(spark, P)
    hole = d.filter("NOT (to_date(ts) = date'2024-03-05' AND hour(ts) = 10)")
    lost = windows.by_time(d, P).select("dt").exceptAll(windows.by_time(hole, P).select("dt"))
    # memory of the two following days, for the windows that hold 10 o'clock
    assert {(r["dt"].day, r["dt"].hour) for r in lost.collect()} == {(x, h) for x in (6, 7) for h in (10, 11, 12)}


def test_memory_ends_with_target(spark):
    d = windows.per_day(full(spark, P), P)
    later = d.select("cell", F.col("dt").alias("t"), F.element_at("m", -1).alias("yesterday"))
    earlier = d.select("cell", (F.col("dt") + F.make_dt_interval(F.lit(1))).alias("t"), F.element_at("y", 1).alias("y"))
    both = later.join(earlier, ["cell", "t"])
    assert both.count() > 0 and both.filter(F.element_at("yesterday", -1) != F.col("y")).count() == 0


def test_short_key_gives_nothing(spark):
    d = full(spark, P).filter("to_date(ts) = date'2024-03-04'")
    for how in ("positional", "per_day", "by_time"):
        assert windows.samples(d, P, how).count() == 0
    assert windows.samples(d.limit(0), P).count() == 0
    with pytest.raises(ValueError):
        windows.samples(d, P, "other")


def test_last_days_and_replicate(spark):
    p = Profile(**{**P.__dict__, "test_days": 2})
    s = windows.last_days_series(full(spark, p), p).first()["series"]
    assert len(s) == 12
    assert split.replicate(spark.range(3), 4).count() == 12
