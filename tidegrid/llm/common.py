"""What the corpus operators share: reading tables, durable intermediates, training folds, components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the space and the five ASCII controls \t \n \v \f \r (fixed by the data contract).
WORD = "[^\\x20\\x09-\\x0D]+"


_made: list[str] = []


#: Rows of texts that go to a Python worker at once, unless the session says otherwise than Spark's default of 10,000: on
#: either side of the pipe a batch and its copies are held outside the heap.
BATCH_ROWS = 4000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A cluster names it in spark.checkpoint.dir; only where that is
    unset (tests, one machine) a temporary folder is made and set."""
    _small_batches(spark)
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder, deleted by drop_durable or else when the driver ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def durable(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: the lineage ends here, a lost executor costs
    nothing that was finished, and what follows scans columns instead of repeating the work."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Where the tables of this process are that were not deleted."""
    return list(_made)


def drop_durable(spark: SparkSession, keep: Sequence[str] = ()) -> None:
    """Deletes the tables that durable() made in this process, but for those kept, once nothing reads them any more."""
    conf = spark._jsc.hadoopConfiguration()
    for name in [m for m in _made if m not in keep]:
        _made.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def training_fold(doc_id: Column) -> Column:
    """True for rows that models may learn from: crc32 of the id's decimal text is not a multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def give_back() -> None:
    """Returns what a worker has freed to the system: Arrow's pool and the C heap would both keep it for themselves, and
    workers of several stages live side by side on an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def worker_memory() -> dict:
    """What outlives a task in a Python worker: a module of our own there. (Functions reach workers by value, so that they
    need no package there, and their globals last for one task.)"""
    return sys.modules.setdefault("_tidegrid_worker", types.ModuleType("_tidegrid_worker")).__dict__


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (u, v): one row (node, root), root the smallest node of its component,
    for every node that has an edge to another.

    Alternating large-star and small-star contraction. Each half round is a map-side combined minimum joined back to
    the edges. Minima and edges are written tables, deleted once the next round's edges are written: a join between two
    exchanges, whose partitions adaptive execution can split where a node has very many edges. No task and no driver ever
    holds a component."""
    spark, others = edges.sparkSession, made()

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        least = durable(least, "components-least")
        joined = both.join(least, F.col("u") == F.col("k"))
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    current = durable(edges.select("u", "v").filter("u != v").distinct(), "components-edges")
    before = None
    while True:  # every round shortens all ways to a root; there are about log2 of the longest
        current = durable(star(star(current, True), False), "components-edges")
        drop_durable(spark, keep=[*others, made()[-1]])
        h = F.xxhash64("u", "v")
        now = tuple(current.agg(F.count(F.lit(1)), F.sum(h % 1_000_003), F.sum(F.shiftright(h, 32))).first())
        if now == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = now
