"""The trend model with changepoints beside plain NumPy."""

from __future__ import annotations

import dataclasses
import datetime
import math

import numpy as np
import pytest

from weekcast.operators import seasonal
from weekcast.operators.seasonal import Shape

START = datetime.date(2015, 1, 5)


def panel(spark, series):
    """Weekly rows of {store: values}."""
    rows = [
        (store, "p", (d := START + datetime.timedelta(days=7 * i)).year, int(d.strftime("%V")), d, None if v is None else float(v))
        for store, values in series.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, "store string, product string, year int, week int, week_date date, quantity double")


def design(days, first, span, shape):
    t = (days - first) / span
    columns = [np.ones(len(t)), t, *[np.maximum(t - k, 0) for k in shape.knots()]]
    for count, length in ((shape.yearly, 365.25), (shape.weekly, 7.0)):
        for k in range(1, count + 1):
            columns += [np.sin(2 * np.pi * k * days / length), np.cos(2 * np.pi * k * days / length)]
    return np.column_stack(columns)


def plain(x, y, noise, shape, steps=400_000):
    """Proximal gradient with momentum on the whole objective."""
    size = x.shape[1]
    change = np.zeros(size, bool)
    change[2 : 2 + shape.changepoints] = True
    ridge = np.where(change, 0.0, 1 / shape.seasonality_prior**2)
    ridge[:2] = 1 / shape.trend_prior**2
    h, b = x.T @ x + noise * np.diag(ridge), x.T @ y
    penalty = np.where(change, noise / shape.changepoint_prior, 0.0)
    step = 1 / np.linalg.eigvalsh(h)[-1]
    w = v = np.zeros(size)
    momentum = 1.0
    for _ in range(steps):
        z = v - step * (h @ v - b)
        new = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0)
        if (new - w) @ (v - new) > 0:
            momentum, v = 1.0, w
            continue
        nxt = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        v = new + (momentum - 1) / nxt * (new - w)
        done = np.abs(new - w).max() < 1e-14
        w, momentum = new, nxt
        if done:
            break
    return w


def objective(w, x, y, noise, shape):
    change = slice(2, 2 + shape.changepoints)
    ridge = np.full(len(w), 1 / shape.seasonality_prior**2)
    ridge[:2], ridge[change] = 1 / shape.trend_prior**2, 0
    return ((y - x @ w) ** 2).sum() / 2 + noise * (ridge * w**2).sum() / 2 + noise / shape.changepoint_prior * np.abs(w[change]).sum()


def kinked(n=260, at=(80, 150), slopes=(0.5, -0.9, 1.4), level=60):
    values, rate = [level], slopes[0]
    for i in range(1, n):
        rate = slopes[sum(i > a for a in at)]
        values.append(values[-1] + rate)
    return np.array(values, dtype=float)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_solver(spark, seed):
    draw = np.random.default_rng(seed)
    shape = Shape(changepoints=8, yearly=2, weekly=0, noise=0.01)
    y = kinked(150, (50, 90)) + draw.normal(0, 3, 150)
    frame = panel(spark, {"a": y, "b": y[::-1]}).selectExpr("*", "week_date < date'2017-06-01' AS train")
    fitted = seasonal.fit_changepoints(frame, "train", shape=shape)
    rows = {r.store: r._w for r in fitted.weights.collect()}
    for store, values in (("a", y), ("b", y[::-1])):
        days = np.array([(START - seasonal.EPOCH).days + 7 * i for i in range(150)], dtype=float)
        used = days < (datetime.date(2017, 6, 1) - seasonal.EPOCH).days
        x, scale = design(days[used], fitted.first, fitted.span, shape), np.abs(values[used]).max()
        want = plain(x, values[used] / scale, shape.noise, shape)
        got = np.array(rows[store][:-1]) / scale
        assert objective(got, x, values[used] / scale, shape.noise, shape) <= objective(want, x, values[used] / scale, shape.noise, shape) + 1e-9
        assert np.allclose(got, want, atol=2e-5)
        shown = seasonal.predict_changepoints(frame.where(f"store = '{store}'"), fitted).orderBy("week_date").collect()
        assert np.allclose([r.prediction for r in shown], np.maximum(design(days, fitted.first, fitted.span, shape) @ got * scale, 0))


def test_planted_kinks_are_found(spark):
    """Two changes of slope, of which the model sees noisy values: every large change lies near a planted one."""
    draw = np.random.default_rng(3)
    y = kinked() + draw.normal(0, 1.0, 260)
    frame = panel(spark, {"kinked": y, "line": 50 + 0.4 * np.arange(260.0), "flat": np.full(260, 7.0)}).selectExpr("*", "true AS train")
    fitted = seasonal.fit_changepoints(frame, "train", shape=Shape(yearly=0, weekly=0))
    found = seasonal.changepoints(fitted).collect()
    assert {r.store for r in found} == {"kinked"}
    planted = [START + datetime.timedelta(days=7 * a) for a in (80, 150)]
    near = 0.8 * 260 * 7 / 25 * 1.5
    total = sum(abs(r.change) for r in found)
    close = [r for r in found if min(abs((r.date - p).days) for p in planted) <= near]
    assert sum(abs(r.change) for r in close) > 0.9 * total
    for p, change in zip(planted, (-1.4, 2.3), strict=True):
        got = sum(r.change for r in found if abs((r.date - p).days) <= near) / 365.25 * 7
        assert got == pytest.approx(change, rel=0.25)
    out = seasonal.predict_changepoints(frame, fitted).collect()
    assert max(abs(r.prediction - r.quantity) for r in out if r.store != "kinked") < 0.05
    error = np.mean([abs(r.prediction - r.quantity) for r in out if r.store == "kinked"])
    assert error < 1.5


def test_without_priors_it_is_least_squares(spark):
    draw = np.random.default_rng(4)
    values = {f"s{i}": draw.normal(20, 5, 40 + i) for i in range(3)}
    frame = panel(spark, values).selectExpr("*", "true AS train")
    shape = Shape(changepoints=3, changepoint_prior=math.inf, trend_prior=math.inf, seasonality_prior=math.inf, yearly=1, weekly=0)
    fitted = seasonal.fit_changepoints(frame, "train", shape=shape)
    for r in fitted.weights.collect():
        y = values[r.store]
        days = np.array([(START - seasonal.EPOCH).days + 7.0 * i for i in range(len(y))])
        x = design(days, fitted.first, fitted.span, shape)
        assert np.allclose(x @ np.array(r._w[:-1]), x @ np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_components_add_up_and_waves_are_found(spark):
    weeks = np.arange(208)
    wave = 10 * np.sin(2 * np.pi * 7 * weeks / 365.25)
    frame = panel(spark, {"w": 100 + wave}).selectExpr("*", "week_date < date'2018-06-01' AS train")
    out = seasonal.predict_changepoints(frame, seasonal.fit_changepoints(frame, "train"), components=True).orderBy("week_date").collect()
    assert np.allclose([r.trend + r.yearly + r.weekly for r in out], [r.prediction for r in out])
    assert np.abs([r.prediction - r.quantity for r in out]).max() < 0.5
    assert np.abs(np.array([r.yearly for r in out]) - wave).max() < 1.0


def test_awkward_series(spark):
    """A single row, values that are missing, all zero, and a series without training rows."""
    series = {"one": [5.0], "holes": [None, 3.0, None, 4.0], "zero": [0.0] * 5, "new": [None, None]}
    frame = panel(spark, series).selectExpr("*", "true AS train")
    for mode in ("additive", "multiplicative"):
        fitted = seasonal.fit_changepoints(frame, "train", shape=dataclasses.replace(Shape(), mode=mode))
        out = {}
        for r in seasonal.predict_changepoints(frame, fitted).collect():
            out.setdefault(r.store, []).append(r.prediction)
        assert out["new"] == [None, None] and all(math.isfinite(p) for s in ("one", "holes", "zero") for p in out[s])
        assert max(out["zero"]) < 1e-6 and out["one"][0] == pytest.approx(5.0, abs=0.2)
    nothing = frame.withColumn("train", frame.train & False)
    assert {r.prediction for r in seasonal.predict_changepoints(frame, seasonal.fit_changepoints(nothing, "train")).collect()} == {None}


def test_regressors(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=60)
    frame = panel(spark, {"r": 30 + 4 * x}).toPandas()
    frame["x"] = x
    frame = spark.createDataFrame(frame).selectExpr("*", "true AS train")
    fitted = seasonal.fit_changepoints(frame, "train", shape=Shape(yearly=0, weekly=0), regressors=["x"])
    out = seasonal.predict_changepoints(frame, fitted).collect()
    assert max(abs(r.prediction - r.quantity) for r in out) < 0.1


def test_sparse_systems_satisfy_the_conditions():
    draw = np.random.default_rng(7)
    a = draw.normal(size=(40, 30, 12))
    a[:20] = np.cumsum(a[:20], axis=2)  # nearly collinear columns
    a[5, :, 3] = 0
    h, b, penalty = np.einsum("sni,snj->sij", a, a), np.einsum("sni,sn->si", a, draw.normal(size=(40, 30))), draw.uniform(0, 8, 40)
    x = np.array([seasonal.lasso(*system) for system in zip(h, b, penalty)])
    slack = b - np.einsum("sij,sj->si", h, x)
    scale = np.abs(b).max(axis=1, keepdims=True)
    assert (np.abs(slack) <= penalty[:, None] + 1e-6 * scale).all()
    assert np.allclose(slack[x != 0], (np.sign(x) * penalty[:, None])[x != 0], atol=1e-5)
