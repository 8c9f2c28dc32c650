"""A key-value table of KPI rows as a Spark data source (format `kvtable`).

The store keeps rows in groups by (evt_dtm, random). The client here reads a folder with one JSON-lines file a group,
named {evt_dtm}_{random}.jsonl; another store needs only its own list_groups and read_group. Comparisons and IN lists on
evt_dtm are taken over by the reader, so only groups that may match are opened, one partition for `groups_per_task` of
them. The sharding column `random` is not part of the table.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import FloatType, IntegerType, StringType, StructField, StructType

FEATURES = ("rsrp", "rsrq", "dl_prb_usage_rate", "sinr", "ue_tx_power", "phr", "ue_conn_tot_cnt", "cqi")
SCHEMA = StructType([StructField("evt_dtm", StringType()), StructField("uniq_id", IntegerType()), *[StructField(c, FloatType()) for c in FEATURES]])
_ARROW = pa.schema([("evt_dtm", pa.string()), ("uniq_id", pa.int32()), *[(c, pa.float32()) for c in FEATURES]])


class FolderClient:
    """The groups of a folder."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def list_groups(self) -> list[tuple[str, str]]:
        return sorted((f.split("_")[0], f) for f in os.listdir(self.folder) if f.endswith(".jsonl"))

    def read_group(self, name: str) -> list[dict]:
        with open(os.path.join(self.folder, name), encoding="utf-8") as f:
            return [json.loads(line) for line in f if line.strip()]


class Groups(InputPartition):
    def __init__(self, names: list[str]) -> None:
        super().__init__(None)
        self.names = names


_TESTS = {
    EqualTo: lambda t, v: t == v, GreaterThan: lambda t, v: t > v, GreaterThanOrEqual: lambda t, v: t >= v,
    LessThan: lambda t, v: t < v, LessThanOrEqual: lambda t, v: t <= v, In: lambda t, v: t in v,
}


class Reader(DataSourceReader):
    def __init__(self, client: FolderClient, groups_per_task: int) -> None:
        self.client, self.groups_per_task, self.tests = client, groups_per_task, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _TESTS and getattr(f, "attribute", None) == ("evt_dtm",):
                self.tests.append((type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[Groups]:
        names = [n for t, n in self.client.list_groups() if all(_TESTS[k](t, v) for k, v in self.tests)]
        return [Groups(names[i : i + self.groups_per_task]) for i in range(0, len(names), self.groups_per_task)] or [Groups([])]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        for name in partition.names:
            rows = self.client.read_group(name)
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


class KvTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kvtable"

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(FolderClient(self.options["path"]), int(self.options.get("groups_per_task", "64")))


def write_groups(df: DataFrame, folder: str) -> int:
    """Rows (evt_dtm, random, uniq_id, features) as the groups of a folder that all executors mount; the number of groups.
    A group's file appears whole under its name, so a repeated task does no harm."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        name = f"{frame['evt_dtm'].iloc[0]}_{frame['random'].iloc[0]}.jsonl"
        part = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        frame.to_json(part, orient="records", lines=True, double_precision=15)
        os.replace(part, os.path.join(folder, name))
        return pd.DataFrame({"groups": [1]})

    return df.groupBy("evt_dtm", "random").applyInPandas(run, "groups long").count()


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(KvTable)
