from datetime import datetime

from pyspark.sql import functions as F

from tidegrid.functions.datetimes import before_days, before_minutes, last_days, move_minutes, parse_text, snap, text_time_filter, time_filter


def one(spark, column, value="20190920094500"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("v")).first()["v"]


def test_moves(spark):
    t = F.col("t")
    assert one(spark, before_minutes(t, 45)) == "20190920090000"
    assert one(spark, before_days(t, 1), "20190901000000") == "20190831000000"
    assert one(spark, before_days(t, 400), "20190901000000") == "20180728000000"
    assert one(spark, move_minutes(t, 0), "no time") == "no time"
    assert one(spark, move_minutes(t, 5), "no time") is None
    assert one(spark, parse_text(t)) == datetime(2019, 9, 20, 9, 45)


def test_filters(spark):
    five = spark.range(0, 86_400 * 3, 300).select((F.lit("2019-09-18").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ts"))
    rows = five.select("ts", F.date_format("ts", "yyyyMMddHHmmss").alias("t"))
    a = rows.filter(text_time_filter(F.col("t"), "20190920094500", 45, 2))
    b = rows.filter(time_filter(F.col("ts"), "20190920094500", 45, 2, F.to_date("ts")))
    assert a.count() == b.count() == 20
    assert rows.filter(text_time_filter(F.col("t"), "20190920095000", 0, 1)).count() == 1
    assert rows.filter(text_time_filter(F.col("t"), "20190920095000", 0, 0)).count() == 0


def test_snap_and_last_days(spark):
    d = spark.sql("SELECT timestamp_ntz'2024-01-05 13:47:31.5' AS ts")
    assert d.select(snap(F.col("ts"), 5)).first()[0] == datetime(2024, 1, 5, 13, 45)
    assert d.select(snap(F.col("ts"), 60)).first()[0] == datetime(2024, 1, 5, 13)
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-01-31')) AS day")
    assert days.filter(last_days(F.col("day"), F.lit("2024-01-31").cast("date"), 7)).count() == 7
