from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_samples import full

from tidegrid import __main__ as cli
from tidegrid.operators import model, windows
from tidegrid.plans import jobs
from tidegrid.profile import Profile
from tidegrid.sources import files

P = Profile(("cqi", "rsrp"), base_seconds=10, step_minutes=60, start_hour=8, end_hour=14, start=datetime(2024, 3, 4), end=datetime(2024, 3, 12), x_len=2, memory_days=2, test_days=2)


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    base = tmp_path_factory.mktemp("logs")
    rng = np.random.default_rng(0)
    for cell in (3, 5):
        lines = ["EVT_DTM,CQI,RSRP"]
        for d in range(8):
            for s in range(0, 6 * 3600, 1200):
                t = datetime(2024, 3, 4 + d, 8) + timedelta(seconds=s)
                lines.append(f"{t:%Y%m%d%H%M%S},{np.sin(s / 7000) + d * 0.1 + rng.normal(0, 0.01):.4f},{-80 - cell + s / 3600:.3f}")
        (base / f"9_{cell}_x.csv").write_text("\n".join(lines))
    return str(base)


def test_from_logs_to_errors(spark, logs, tmp_path):
    out = str(tmp_path)
    table = jobs.preprocess(spark, logs, ["9_5", "9_3"], out, P, keep_resampled=True)
    assert table.count() == 2 * 8 * 6
    top = table.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in P.features]).first()
    assert all(abs(abs(v) - 1) < 1e-6 for v in top)
    low = files.read_table(spark, f"{out}/resampled", P).filter("hour(ts) = 8").groupBy("cell").agg(F.round(F.avg("rsrp"), 3).alias("r")).collect()
    assert {r["cell"]: r["r"] for r in low} == {0: pytest.approx(-84.667, abs=1e-3), 1: pytest.approx(-82.667, abs=1e-3)}
    parts = {r["part"]: r["n"] for r in jobs.dataset(table, P).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"test": 16, "dev": 2, "train": 22}
    run = jobs.fit(spark, table, f"{out}/runs", P, epochs=15, rate=1e-2)
    assert spark.read.parquet(f"{run}/history").count() >= 1
    row = jobs.evaluate(spark, table, f"{out}/runs", f"{out}/results", P).first()
    assert row["n"] == 32 and 0 < row["mse"] < 2
    one = jobs.dataset(table, P, [1], "positional")
    assert {r["cell"] for r in one.select("cell").distinct().collect()} == {1}


def test_seed_zero_differs_from_seven(spark, logs, tmp_path):
    table = jobs.preprocess(spark, logs, ["9_5"], str(tmp_path), P)
    p = Profile(**{**P.__dict__, "dev_ratio": 0.4})
    dev = lambda seed: {r["dt"] for r in jobs.dataset(table, p, seed=seed).filter("part = 'dev'").collect()}
    assert dev(0) == dev(0) and dev(0) != dev(7)


def test_near_real_time(spark):
    p = Profile(**{**P.__dict__, "end": datetime(2024, 3, 9)})
    d = full(spark, p, 2)
    w = model.random_weights(p, 4, seed=1)
    got = jobs.near_real_time(d.union(d.limit(3)), "20240308090000", w, p, steps=2)
    s = windows.by_time(d, p).filter("dt IN (timestamp_ntz'2024-03-08 11:00:00', timestamp_ntz'2024-03-08 12:00:00')")
    want = {(r["cell"], r["dt"].hour - 1): r["pred"] for r in model.predict(s, w, p).collect()}
    assert {(r["cell"], int(r["at"][8:10])): pytest.approx(r["pred"]) for r in got.collect()} == want and len(want) == 4
    ranges = {"cqi": (0.0, 3e6), "rsrp": (0.0, 3e6)}
    row = jobs.near_real_time(d, "20240308090000", w, p, ranges).first()
    assert row["value"] == pytest.approx([(v + 1) * 1.5e6 for v in row["pred"]])


def test_steps_read_in_proportion(spark):
    """Every step reads the kept queues and its own rows: reads grow with the steps, and none repeats those before it."""
    p = Profile(**{**P.__dict__, "end": datetime(2024, 3, 9)})
    w = model.random_weights(p, 4, seed=1)
    reads = {}
    for steps in (1, 4):
        d = files.kept(full(spark, p, 2), "rows")
        plan = jobs.near_real_time(d, "20240308080000", w, p, steps=steps)._jdf.queryExecution().executedPlan().toString()
        reads[steps] = plan.count("FileScan")
    assert reads[1] == 2 and reads[4] == 8


def test_last_row_by_order(spark):
    p = Profile(**{**P.__dict__, "end": datetime(2024, 3, 9)})
    d = full(spark, p).withColumn("place", F.lit(1))
    changed = d.filter("ts = timestamp_ntz'2024-03-08 10:00:00'").withColumns({"place": F.lit(2), "cqi": F.col("cqi") - 1000})
    live = jobs.Live.start(d.union(changed), "20240308090000", p, order=["place"]).advance()
    assert live.x.first()["queue"][-1][0] == changed.first()["cqi"]


def test_infer(spark):
    s = windows.by_time(full(spark, P), P).select("x", "m")
    n = s.count()
    assert jobs.infer(s, model.random_weights(P, 3), P, times=3, partitions=2).count() == 3 * n


def test_samples_written(spark, tmp_path):
    s = windows.by_time(full(spark, P), P)
    files.write_samples(s, str(tmp_path / "s"), 2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2 * s.count()


def test_command_line():
    with pytest.raises(SystemExit):
        cli.main(["--help"])
    with pytest.raises(SystemExit):
        cli.main(["train"])
