from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from tests.test_samples import full

from tidegrid.operators import asof, windows
from tidegrid.operators.resample import step_means
from tidegrid.profile import Profile
from tidegrid.streaming.queues import live_features, live_step_means

P = Profile(("a", "b"), step_minutes=60, start_hour=8, end_hour=14, start=datetime(2024, 3, 4), end=datetime(2024, 3, 9), x_len=2, memory_days=2)
DAY = Profile(("a",), step_minutes=5, start_hour=0, end_hour=24, start=datetime(2019, 9, 12), end=datetime(2019, 9, 21))


def plain(rows, *columns):
    return {r["cell"]: tuple(r[c] for c in columns) for r in rows.collect()}


def test_reference_times(spark):
    """From 09:45: after one step x is 09:05 to 09:50, memory 09:05 to 09:55 on seven earlier days."""
    d = full(spark, DAY).withColumn("a", (F.dayofmonth("ts") * 10_000 + F.hour("ts") * 100 + F.minute("ts")).cast("double"))
    x = asof.advance_input(asof.input_queue(d, "20190920094500", DAY), d, "20190920095000", DAY)
    m = asof.advance_memory(asof.memory_queue(d, asof.moved("20190920094500", 5, -1), DAY), d, asof.moved("20190920094500", 10, -1), DAY)
    row = asof.pair(x, m, DAY).first()
    assert [v[0] for v in row["x"]] == [200_905 + 5 * i for i in range(10)]
    assert [[v[0] for v in day] for day in row["m"]] == [[d * 10_000 + 905 + 5 * i for i in range(11)] for d in range(13, 20)]


def test_features_equal_samples(spark):
    d = full(spark, P, 2)
    got = plain(asof.features_at(d, "20240308100000", P), "x", "m")
    want = plain(windows.by_time(d, P).filter("dt = timestamp_ntz'2024-03-08 11:00:00'"), "x", "m")
    assert got == want and len(got) == 2


def test_missing_keys(spark):
    d = full(spark, P, 2)
    q = asof.input_queue(d, "20240308100000", P)
    gone = d.filter("NOT (cell = 1 AND ts = timestamp_ntz'2024-03-08 11:00:00')")
    assert set(plain(asof.advance_input(q, gone, "20240308110000", P), "queue")) == {0}
    stale = plain(asof.advance_input(q, gone, "20240308110000", P, "stale"), "queue")
    assert stale[1] == plain(q, "queue")[1] and stale[0] != plain(q, "queue")[0]
    m = asof.memory_queue(d.filter("cell = 0"), "20240307110000", P)
    assert [r["cell"] for r in asof.unpaired(q, m, P).collect()] == [1]
    assert asof.input_queue(d, "20240308080000", P).count() == 0  # would need 07:00


def test_memory_over_midnight(spark):
    p = Profile(("a",), step_minutes=60, start_hour=0, end_hour=24, start=datetime(2024, 3, 4), end=datetime(2024, 3, 9), x_len=2, memory_days=2)
    q = asof.memory_queue(full(spark, p), "20240307010000", p).first()
    assert [[v[0] % 100 for v in day] for day in q["days"]] == [[23.0, 0.0, 1.0]] * 2


def test_stream_equals_batch(spark, tmp_path):
    d = full(spark, P, 2)
    day = lambda a, b: d.filter(f"to_date(ts) >= date'{a}' AND to_date(ts) < date'{b}'")
    day("2024-03-04", "2024-03-07").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))

    def run():
        q = live_features(stream, P).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    day("2024-03-07", "2024-03-09").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()  # goes on from the kept state
    got = spark.read.parquet(str(tmp_path / "out"))
    stamped = got.select("cell", (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.col("at") + 3600).cast("decimal(18,6)"))).alias("dt"), "x", "m")
    want = windows.by_time(d, P).select("cell", "dt", "x", "m")
    # a live sample needs no target yet, so it also exists where the next step never comes
    assert want.count() == 24 and want.exceptAll(stamped).count() == 0
    assert stamped.count() >= 24


@pytest.mark.parametrize("late", [5, 600])
def test_live_means(spark, tmp_path, late):
    rows = [(0, datetime(2024, 3, 4, 8) + timedelta(minutes=m), float(m), 1.0) for m in (0, 30, 60, 90, 240)]
    spark.createDataFrame(rows, "cell int, ts timestamp_ntz, a double, b double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell int, ts timestamp_ntz, a double, b double").parquet(str(tmp_path / "in"))
    q = live_step_means(stream, P, f"{late} minutes").writeStream.format("memory").queryName(f"means_{late}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["ts"].hour: r["a"] for r in spark.table(f"means_{late}").collect()}
    assert got == ({8: 15.0, 9: 75.0} if late == 5 else {})


def test_live_means_equal_batch(spark, tmp_path):
    """NaN counts as missing, and rows outside the hours, the time span or the base grid are left out, as in step_means."""
    nan = float("nan")
    rows = [(0, datetime(2024, 3, 4, 9, 0), nan, 1.0), (0, datetime(2024, 3, 4, 9, 10), 4.0, 2.0), (0, datetime(2024, 3, 4, 9, 0, 3), 99.0, 9.0), (0, datetime(2024, 3, 4, 23), 5.0, 5.0), (0, datetime(2024, 3, 5, 9), 1.0, 1.0), (0, datetime(2024, 3, 11, 9), 1.0, 1.0)]
    d = spark.createDataFrame(rows, "cell int, ts timestamp_ntz, a double, b double")
    d.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        q = live_step_means(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), P, "1 minute").writeStream.format("memory").queryName("means_like_batch").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = sorted(map(tuple, spark.table("means_like_batch").collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == sorted(map(tuple, step_means(d, P).collect())) and got[0][2:] == (4.0, 1.5)
