import json
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators.scaling import value_range
from tidegrid.profile import Profile
from tidegrid.sources import files, kv

P = Profile(("cqi", "rsrp"), start=datetime(2024, 3, 4), end=datetime(2024, 3, 5))


def test_logs(spark, tmp_path):
    (tmp_path / "7_1_a.csv").write_text("EVT_DTM,CQI,other,RSRP\n20240304080000,1,x,5\n20240304080000,2,x,\n20240304080010,bad,x,7\n")
    (tmp_path / "7_1_b.csv").write_text("EVT_DTM,CQI,other,RSRP\n20240304080010,9,x,nan\nno time,9,x,1\n")
    (tmp_path / "7_2_a.csv").write_text("EVT_DTM,CQI,other,RSRP\n20240304080000,5,x,5\n")
    rows = files.read_logs(spark, str(tmp_path), "7", "1", P).filter("ts IS NOT NULL").orderBy("ts").collect()
    assert [(r["ts"].second, r["cqi"]) for r in rows] == [(0, 2.0), (10, 9.0)]
    assert rows[0]["rsrp"] is None and np.isnan(rows[1]["rsrp"])
    keys = spark.createDataFrame([("7_1",)], "id string").select(*files.split_key("id")).first()
    assert tuple(keys) == ("7", "1")


def test_tables_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(datetime(2024, 3, 4, 8), 1.5, -2.0, 3)], "ts timestamp_ntz, cqi float, rsrp float, cell int")
    files.write_table(d, str(tmp_path / "t"), P)
    assert files.read_table(spark, str(tmp_path / "t"), P).collect() == d.collect()
    assert files.read_indexed(spark, str(tmp_path / "t"), P).collect() == d.collect()
    ranges = value_range(d, P.features)
    files.write_ranges(ranges, str(tmp_path / "r"))
    assert sorted(files.read_ranges(spark, str(tmp_path / "r")).collect()) == sorted(ranges.collect())


def test_npy(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(4, 3, 2)
    np.save(tmp_path / "x.npy", a)
    rows = files.read_npy(spark, str(tmp_path / "x.npy")).orderBy("at").collect()
    assert [r["at"] for r in rows] == [0, 1, 2, 3] and rows[0]["shape"] == [3, 2]
    assert np.array_equal(np.array([r["value"] for r in rows]).reshape(4, 3, 2), a)


def test_runs(spark, tmp_path):
    base = str(tmp_path / "runs")
    assert files.latest_run(spark, base) is None
    assert files.new_run(spark, base, date(2024, 3, 4)).endswith("20240304-00")
    assert files.new_run(spark, base, date(2024, 3, 4)).endswith("20240304-01")
    files.new_run(spark, base, date(2024, 2, 28))
    assert files.latest_run(spark, base).endswith("20240304-01")


def test_predictions(spark, tmp_path):
    d = spark.createDataFrame([(1, datetime(2024, 3, 4), [1.0], [2.0])], "cell int, dt timestamp_ntz, y array<double>, pred array<double>")
    files.write_predictions(d, str(tmp_path / "p"), P)
    assert spark.read.parquet(str(tmp_path / "p")).collect() == d.collect()
    files.write_predictions(d, str(tmp_path / "t"), P, "text")
    assert json.loads(spark.read.text(str(tmp_path / "t")).first()[0])["pred"] == [2.0]
    assert files.from_rows(spark, [(1,)], "a int", 3).count() == 1


def test_kv(spark, tmp_path):
    for t in ("20240304080000", "20240304080500", "20240304081000"):
        for r in range(2):
            (tmp_path / f"{t}_{r}.jsonl").write_text("\n".join(json.dumps({"evt_dtm": t, "uniq_id": 10 * r + i, "rsrp": -1.5, "random": r}) for i in range(3)))
    kv.register(spark)
    d = spark.read.format("kvtable").option("path", str(tmp_path)).option("groups_per_task", "1").load()
    assert d.count() == 18 and "random" not in d.columns
    part = d.filter("evt_dtm >= '20240304080500' AND evt_dtm <= '20240304080500' AND uniq_id < 12")
    assert part.count() == 5
    assert part.select("rsrp", "cqi").distinct().collect()[0]["cqi"] is None
    reader = kv.Reader(kv.FolderClient(str(tmp_path)), 1)
    assert list(reader.pushFilters([kv.EqualTo(("evt_dtm",), "20240304080000"), kv.EqualTo(("uniq_id",), 1)]))[0].attribute == ("uniq_id",)
    assert len(reader.partitions()) == 2
    assert d.filter(F.col("evt_dtm").isin("20240304080000", "x")).count() == 6


def test_logs_by_name(spark, tmp_path):
    """Files with their columns in another order, one without a feature, an empty one, a header with a byte order mark."""
    (tmp_path / "7_1_a.csv").write_text("EVT_DTM,RSRP,CQI\n20240304080000,-61,6\n")
    (tmp_path / "7_1_b.csv").write_text("EVT_DTM,CQI,RSRP\n20240304080010,7,-62\n")
    (tmp_path / "7_1_c.csv").write_text("﻿cqi,evt_dtm\n8,20240304080020\n9,20240304080000\n")
    (tmp_path / "7_1_d.csv").write_text("")
    (tmp_path / "7_2_a.csv").write_text("EVT_DTM,CQI,RSRP\n20240304080010,1,-1\n")
    rows = files.read_logs_of(spark, str(tmp_path), [("7", "1"), ("7", "2")], P).orderBy("cell_no", "ts").collect()
    assert [(r["station"], r["cell_no"], r["ts"].second, r["cqi"], r["rsrp"]) for r in rows] == [("7", "1", 0, 9.0, None), ("7", "1", 10, 7.0, -62.0), ("7", "1", 20, 8.0, None), ("7", "2", 10, 1.0, -1.0)]
    with pytest.raises(FileNotFoundError):
        files.read_logs(spark, str(tmp_path), "8", "1", P)
    (tmp_path / "9_1_a.csv").write_text("TIME,CQI\n1,2\n")
    with pytest.raises(ValueError):
        files.read_logs(spark, str(tmp_path), "9", "1", P)


def test_npy_round_trip(spark, tmp_path):
    d = spark.createDataFrame([(c, 2 - k, [float(k), float(c)]) for c in (1, 2) for k in range(3)], "cell int, at int, v array<double>")
    files.write_npy(d, str(tmp_path), "cell", "at", "v")
    assert np.load(tmp_path / "2.npy").tolist() == [[2.0, 2.0], [1.0, 2.0], [0.0, 2.0]]
    assert files.read_npy(spark, str(tmp_path)).count() == 6


def test_kept_and_log(spark, tmp_path):
    d = files.kept(spark.range(3), "kept")
    assert d.count() == 3 and len(d.inputFiles()) >= 1
    files.write_log(spark, str(tmp_path), ["a", "b"])
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "log")).collect()) == ["a", "b"]
