"""File sources and sinks: KPI logs, resampled tables, ranges, tensors, predictions, dated run folders."""

from __future__ import annotations

import csv
import io
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.datetimes import parse_text
from ..operators.split import replicate
from ..operators.timegrid import keep_last, union_all
from ..profile import Profile


def _headers(spark: SparkSession, patterns: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of the patterns by their header's names (lower case): a listing, and the first line of each file."""
    jvm, conf, out = spark._jvm, spark._jsc.hadoopConfiguration(), {}
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(conf)
        for status in fs.globStatus(path) or []:
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(status.getPath()), "UTF-8"))
            try:
                first = lines.readLine()
            finally:
                lines.close()
            names = tuple(c.strip().lower() for c in next(csv.reader([(first or "").lstrip("\ufeff")]), []))
            out.setdefault(names, []).append(status.getPath().toString())
    return out


def read_logs_of(spark: SparkSession, base: str, keys: Sequence[tuple[str, str]], p: Profile, dedup: bool = True) -> DataFrame:
    """All files {station}_{cell}_*.csv of the keys: station, cell_no (from the file name), time, features.

    Columns are found by each file's own header: files with one header are one scan, the scans are united by name. A feature
    that a file doesn't have is null there, as is text that is no number; columns outside the profile are not read. Of
    rows with one time the last by file name and place in the file stays. Empty files are left out; a file whose header
    has no EVT_DTM is an error, as is a key without files."""
    frames = []
    found = _headers(spark, [f"{base}/{station}_{cell}_*.csv" for station, cell in keys])
    for names, paths in sorted(found.items()):
        if not any(names):
            continue
        if "evt_dtm" not in names:
            raise ValueError(f"no column EVT_DTM in {paths[0]}")
        place = {c: F.col(f"c{i}") for i, c in enumerate(names)}
        text = spark.read.option("header", True).schema(", ".join(f"c{i} string" for i in range(len(names)))).csv(paths)
        number = lambda c, place=place: place[c].try_cast("double") if c in place else F.lit(None).cast("double")
        name = F.split("_metadata.file_name", "_")
        frames.append(text.select(
            F.element_at(name, 1).alias("station"), F.element_at(name, 2).alias("cell_no"), parse_text(place["evt_dtm"]).alias(p.time),
            *[number(c).alias(c) for c in p.features],
            F.col("_metadata.file_name").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"),
        ))
    if not frames:
        raise FileNotFoundError(f"no logs of {list(keys)} in {base}")
    d = union_all(*frames)
    if dedup:
        d = keep_last(d, ["station", "cell_no", p.time], ["__file", "__block", "__row"])
    return d.drop("__file", "__block", "__row")


def read_logs(spark: SparkSession, base: str, station: str, cell: str, p: Profile, dedup: bool = True) -> DataFrame:
    """The logs of one key, as read_logs_of has them."""
    return read_logs_of(spark, base, [(station, cell)], p, dedup)


def collect_logs(spark: SparkSession, written: str, key: str, base: str, station: str, label: str) -> None:
    """Renames what Spark wrote as CSV by a partition column to base/{station}_{cell}_{label}{n}.csv."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(written)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for n, status in enumerate(fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{written}/{key}=*/*.csv")) or []):
        cell = status.getPath().getParent().getName().partition("=")[2]
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(f"{base}/{station}_{cell}_{label}{n:05d}.csv"))


def split_key(c: str, into: tuple[str, str] = ("station", "cell_no")):
    """`A_B` as two columns."""
    return [F.element_at(F.split(c, "_"), i + 1).alias(n) for i, n in enumerate(into)]


def table_schema(p: Profile) -> T.StructType:
    return T.StructType([T.StructField(p.time, T.TimestampNTZType()), *[T.StructField(c, T.FloatType()) for c in p.features], T.StructField(p.key, T.IntegerType())])


def read_table(spark: SparkSession, path: str, p: Profile) -> DataFrame:
    """A resampled or scaled table as CSV with header, by position."""
    return spark.read.option("header", True).option("enforceSchema", True).schema(table_schema(p)).csv(path)


def read_indexed(spark: SparkSession, path: str, p: Profile) -> DataFrame:
    """The same where the first column is an unnamed time index as text."""
    fields = [T.StructField("__index", T.StringType()), *table_schema(p).fields[1:]]
    d = spark.read.option("header", True).option("enforceSchema", True).schema(T.StructType(fields)).csv(path)
    return d.select(F.try_to_timestamp("__index").cast("timestamp_ntz").alias(p.time), *[f.name for f in fields[1:]])


def write_table(df: DataFrame, path: str, p: Profile, kind: str = "csv") -> None:
    """Columns in table order, one sort by key and time within partitions by key."""
    d = df.select(p.time, *p.features, p.key).repartition(p.key).sortWithinPartitions(p.key, p.time)
    w = d.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.format(kind).save(path)


def write_ranges(ranges: DataFrame, path: str) -> None:
    ranges.coalesce(1).write.mode("overwrite").parquet(path)


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_rows(spark: SparkSession, rows, schema: str, partitions: int | None = None) -> DataFrame:
    """An in-memory source, in so many partitions."""
    d = spark.createDataFrame(rows, schema)
    return d.repartition(partitions) if partitions else d


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """.npy files as path, at (place on the first axis), shape (of an entry), value (its flat numbers)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                for k in range(0, len(a), 4096):
                    part = a[k : k + 4096].astype(np.float64)
                    yield pd.DataFrame({"path": name, "at": np.arange(k, k + len(part)), "shape": [list(part.shape[1:])] * len(part), "value": list(part.reshape(len(part), -1))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, at long, shape array<int>, value array<double>")


def npy_files(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """key and content: each key's values of an array column, in order, as the bytes of one .npy file (32-bit floats).
    A key's series is one row, so it must fit into a task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.array(frame.sort_values(order, kind="stable")[column].tolist(), np.float32), allow_pickle=False)
        return pd.DataFrame({key: frame[key].iloc[:1].to_numpy(), "content": [out.getvalue()]})

    return df.select(key, order, column).groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, content binary")


def write_npy(df: DataFrame, path: str, key: str, order: str, column: str) -> None:
    """The files of npy_files as path/{key}.npy, one after the other through the driver, in any file system that Spark
    writes to."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for r in npy_files(df, key, order, column).toLocalIterator():
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/{r[key]}.npy")
        out = target.getFileSystem(conf).create(target, True)
        try:
            out.write(bytearray(r["content"]))
        finally:
            out.close()


def write_predictions(df: DataFrame, path: str, p: Profile, kind: str = "parquet") -> None:
    """key, dt, y and pred, keyed rather than by position; kind `text` writes one JSON line each."""
    d = df.select(p.key, "dt", *[c for c in ("y", "pred") if c in df.columns])
    (d.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path) if kind == "text" else d.write.mode("overwrite").format(kind).save(path))


_DATED = re.compile(r"(\d{8})-(\d{2,})$")


def _children(spark: SparkSession, base: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []


def latest_run(spark: SparkSession, base: str) -> str | None:
    """The folder YYYYMMDD-NN of the latest date and then the highest number, in any file system that Spark reads."""
    found = [(m[1], int(m[2]), m[0]) for c in _children(spark, base) if (m := _DATED.match(c))]
    return f"{base}/{max(found)[2]}" if found else None


def new_run(spark: SparkSession, base: str, day: date) -> str:
    """The path of the day's next free folder; it is made."""
    stamp = day.strftime("%Y%m%d")
    taken = [int(m[2]) for c in _children(spark, base) if (m := _DATED.match(c)) and m[1] == stamp]
    out = f"{base}/{stamp}-{max(taken, default=-1) + 1:02d}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return out


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that executors share: that of spark.checkpoint.dir or the context's checkpoints. Where
    neither is set a temporary one is made, on one machine only."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base and not (held := sc._jsc.sc().getCheckpointDir()).isEmpty():
        base = held.get()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidegrid-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """df written into the shared folder and read back, so that what follows neither repeats it nor grows its plan."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_log(spark: SparkSession, run: str, lines: Sequence[str]) -> None:
    """The log of a run, next to what it wrote."""
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(f"{run}/log")


def write_samples(samples: DataFrame, path: str, times: int = 1) -> None:
    """Samples, each so many times, as array columns."""
    (replicate(samples, times) if times > 1 else samples).write.mode("overwrite").parquet(path)
