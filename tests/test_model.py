from dataclasses import fields, replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import metrics, model, train
from tidegrid.profile import KPI, Profile

P = Profile(("a", "b"), step_minutes=60, start=datetime(2024, 1, 1), end=datetime(2024, 1, 20), x_len=3, memory_days=2)


def data(n=12, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, P.x_len, 2)), rng.normal(size=(n, P.memory_days, P.m_len, 2)), rng.uniform(-0.9, 0.9, size=(n, 2))


def samples(spark, n=12):
    x, m, y = data(n)
    return spark.createDataFrame([(i, a.tolist(), b.tolist(), [c.tolist()]) for i, (a, b, c) in enumerate(zip(x, m, y, strict=True))], "cell int, x array<array<double>>, m array<array<array<double>>>, y array<array<double>>")


def test_size():
    assert model.random_weights(KPI).count == 665


def test_two_forward_passes(spark):
    w = model.random_weights(P, 5, seed=2)
    s = samples(spark)
    want = model.forward(w, *data()[:2])
    for how in (model.predict, model.predict_native):
        got = {r["cell"]: r["pred"] for r in how(s, w, P).collect()}
        assert np.allclose([got[i] for i in range(12)], want)


def test_independent_of_batches(spark):
    w = model.random_weights(P, 5, seed=2)
    x, m, _ = data()
    assert np.allclose(model.forward(w, x, m), np.concatenate([model.forward(w, x[i : i + 1], m[i : i + 1]) for i in range(12)]))
    one = model.predict(samples(spark).repartition(1), w, P).orderBy("cell").collect()
    assert [r["pred"] for r in one] == [r["pred"] for r in model.predict(samples(spark).repartition(5), w, P).orderBy("cell").collect()]


def test_slopes():
    w = model.random_weights(P, 3, seed=1)
    x, m, y = data(5)
    _, slopes = train.loss_and_slopes(w, x, m, y)
    for f in fields(w):
        value = getattr(w, f.name)
        for at in np.ndindex(*value.shape):
            up, down = value.copy(), value.copy()
            up[at] += 1e-6
            down[at] -= 1e-6
            numeric = (train.loss_and_slopes(replace(w, **{f.name: up}), x, m, y)[0] - train.loss_and_slopes(replace(w, **{f.name: down}), x, m, y)[0]) / 2e-6
            assert slopes[f.name][at] == pytest.approx(numeric, abs=1e-7)


def test_training_improves_and_stops(spark):
    truth = model.random_weights(P, 3, seed=5)
    x, m, _ = data(200, 3)
    y = model.forward(replace(truth, x_w=truth.x_w * 8), x, m)
    done = train.fit((x[:150], m[:150], y[:150]), (x[150:], m[150:], y[150:]), model.random_weights(P, 3, seed=6), epochs=40, rate=5e-3)
    assert done.history[-1][2] < 0.5 * done.history[0][2]
    flat = train.fit((x[:10], m[:10], y[:10]), (x[10:20], m[10:20], y[10:20]), truth, epochs=50, rate=0.0, patience=3)
    assert len(flat.history) == 4


def test_weights_round_trip(spark, tmp_path):
    w = model.random_weights(P, 4, seed=3)
    model.save_weights(spark, w, str(tmp_path / "w"))
    back = model.load_weights(spark, str(tmp_path / "w"))
    assert all((getattr(w, f.name) == getattr(back, f.name)).all() for f in fields(w))


def test_errors_golden(spark):
    d = spark.createDataFrame([([1.0], [3.0])], "y array<double>, pred array<double>")
    assert metrics.errors(d).first()["smape"] == 1.0
    d = spark.createDataFrame([([0.0, 2.0], [0.0, 1.0])], "y array<double>, pred array<double>")
    e = metrics.errors(d).first()
    assert e["rse"] == pytest.approx(1 / np.sqrt(2)) and e["mse"] == 0.5 and e["mae"] == 0.5
    assert (e["mape"], e["n_mape"], e["n_smape"]) == (0.5, 1, 1)
    assert metrics.errors(d.filter(F.lit(False))).first()["n"] == 0


def test_evaluate(spark):
    assert train.evaluate(samples(spark), model.fixed_weights(P, 4), P).first()["n"] == 24


def test_train_on_all_rows(spark):
    """Slopes summed over partitions are those of all rows at once: the same losses as full batches on arrays."""
    x, m, y = data(40, 4)
    rows = [(i, a.tolist(), b.tolist(), [c.tolist()], "train" if i < 30 else "dev") for i, (a, b, c) in enumerate(zip(x, m, y, strict=True))]
    s = spark.createDataFrame(rows, "cell int, x array<array<double>>, m array<array<array<double>>>, y array<array<double>>, part string").repartition(5)
    done = train.train(s, P, 3, seed=2, epochs=4, rate=1e-2)
    want = train.fit((x[:30], m[:30], y[:30]), (x[30:], m[30:], y[30:]), model.random_weights(P, 3, 2), epochs=4, batch=30, rate=1e-2)
    assert np.allclose(done.history, want.history)
    assert train.train(s.filter("part = 'dev'"), P, 3, epochs=2).history == []


def test_clip():
    w = model.random_weights(P, 3, seed=1)
    big = {f.name: np.full_like(getattr(w, f.name), 100.0) for f in fields(w)}
    clipped, free = train.Adam(), train.Adam(clip=None)
    clipped.move(w, big)
    free.move(w, big)
    assert np.sqrt(sum((v**2).sum() for v in clipped.first.values())) == pytest.approx(0.5) and free.first["out"].max() == pytest.approx(10.0)
