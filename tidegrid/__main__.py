"""Command line of the jobs, for the KPI profile."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.datetimes import parse_text
from .operators import model
from .plans import jobs
from .profile import KPI, KPI_RANGES
from .sources import files, kv


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidegrid")
    sub = parser.add_subparsers(dest="job", required=True)
    a = sub.add_parser("preprocess", help="CSV logs to a scaled table and its ranges")
    a.add_argument("base")
    a.add_argument("out")
    a.add_argument("keys", nargs="+", metavar="STATION_CELL")
    a.add_argument("--keep-resampled", action="store_true")
    for name, text in (("train", "fit the forecaster"), ("evaluate", "forecast the test part with the latest weights")):
        a = sub.add_parser(name, help=text)
        a.add_argument("table")
        a.add_argument("runs")
        a.add_argument("--cells", type=int, nargs="*")
        if name == "train":
            a.add_argument("--epochs", type=int, default=1000)
        else:
            a.add_argument("--out", default="results")
    a = sub.add_parser("infer", help="forecasts of samples in batches with the latest weights")
    a.add_argument("samples", help="Parquet with x and m")
    a.add_argument("runs")
    a.add_argument("out")
    a.add_argument("--times", type=int, default=1, help="each sample so many times")
    a.add_argument("--partitions", type=int)
    a = sub.add_parser("live", help="features as of a time, advanced step by step, with forecasts")
    a.add_argument("table", help="folder of the key-value table, or Parquet with cell, ts and features")
    a.add_argument("runs")
    a.add_argument("out")
    a.add_argument("--at", required=True, metavar="yyyyMMddHHmmss")
    a.add_argument("--steps", type=int, default=1)
    a.add_argument("--kv", action="store_true", help="the table is a key-value store")
    o = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"tidegrid-{o.job}").getOrCreate()
    if o.job == "preprocess":
        jobs.preprocess(spark, o.base, o.keys, o.out, KPI, o.keep_resampled)
    elif o.job == "train":
        print(jobs.fit(spark, files.read_table(spark, o.table, KPI), o.runs, KPI, o.cells, epochs=o.epochs))
    elif o.job == "infer":
        weights = model.load_weights(spark, f"{files.latest_run(spark, o.runs)}/weights")
        jobs.infer(spark.read.parquet(o.samples), weights, KPI, o.times, o.partitions).write.mode("overwrite").parquet(o.out)
    elif o.job == "live":
        weights = model.load_weights(spark, f"{files.latest_run(spark, o.runs)}/weights")
        if o.kv:
            kv.register(spark)
            d = spark.read.format("kvtable").option("path", o.table).load()
            d = d.withColumns({KPI.time: parse_text(F.col("evt_dtm")), KPI.key: F.col("uniq_id")})
        else:
            d = spark.read.parquet(o.table)
        jobs.near_real_time(d, o.at, weights, KPI, KPI_RANGES, o.steps).write.mode("overwrite").parquet(o.out)
    else:
        jobs.evaluate(spark, files.read_table(spark, o.table, KPI), o.runs, o.out, KPI, o.cells).show()


if __name__ == "__main__":
    main()
