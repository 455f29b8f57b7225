from __future__ import annotations

import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthloom.config import EXOG_COLS, FEATURE_COLS, HOLT_WINTERS, LINEAR, MLP, SARIMA, PanelConfig
from monthloom.operators.features import add_features, series_arrays, split_by_time
from monthloom.operators.history import history
from monthloom.operators.holtwinters import fit_holtwinters, predict_holtwinters, smooth
from monthloom.operators.linear import coefficient_report, fit_linear, fit_linear_pooled, predict_linear
from monthloom.operators.mlp import (
    Z_COLS, Network, forward, full_gradient, gradient, network_expression, predict_network, train_network,
)
from monthloom.operators.sarima import WEIGHTS, error_path, fit_sarima, predict_sarima
from monthloom.operators.scaling import standardise
from monthloom.plans.forecasting import forecast_all, forecast_status
from monthloom.plans.training import FittedModels, evaluate_models, prepare
from monthloom.sources.store import load_models, read_losses, save_evaluation, save_models, save_panel
from tests.conftest import month

QUICK = PanelConfig(anomaly_years=(2003,), mlp_epochs=6, mlp_local_epochs=3)


def noisy(n: int, seed: int, level: float = 200.0) -> list[int]:
    rng = random.Random(seed)
    return [round(level + 0.8 * t + 40 * math.sin(2 * math.pi * t / 12) + rng.gauss(0, 8)) for t in range(n)]


@pytest.fixture(scope="module")
def panel(make_panel):
    return make_panel({"a": noisy(90, 1), "b": noisy(84, 2, 80.0), "short": noisy(30, 3), "none": noisy(20, 4)}).cache()


@pytest.fixture(scope="module")
def scaled(panel):
    return prepare(panel, QUICK).cache()


# Least squares


def test_linear_recovers_coefficients(spark):
    rng = random.Random(1)
    rows = [("s", month(i), x1, x2, 3 + 2 * x1 - x2) for i in range(40) for x1, x2 in [(rng.random(), rng.random())]]
    frame = spark.createDataFrame(rows, "series_id string, ds date, x1 double, x2 double, y double")
    params = fit_linear(frame, ("x1", "x2"), "y")
    got = coefficient_report(params, ("x1", "x2")).orderBy("position").collect()
    assert [(r.feature, round(r.coefficient, 9), r.sign) for r in got] == [("intercept", 3, "+"), ("x1", 2, "+"), ("x2", -1, "-")]
    assert max(abs(r.yhat - r.y) for r in predict_linear(frame, params, ("x1", "x2")).collect()) < 1e-9


def test_linear_equals_least_squares_and_residuals_are_orthogonal(scaled):
    train = scaled.where("split = 'train' AND series_id IN ('a', 'b')")
    params = fit_linear(train, Z_COLS, "z_y")
    rows = predict_linear(train, params, Z_COLS).toPandas()
    for name, part in rows.groupby("series_id"):
        x = part[list(Z_COLS)].to_numpy(float)
        y = part["z_y"].to_numpy(float)
        assert np.abs(x.T @ (y - part["yhat"])).max() < 1e-8
        want = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
        report = coefficient_report(params.where(F.col("series_id") == name), Z_COLS).orderBy("position").toPandas()
        assert np.allclose(report["coefficient"], want, atol=1e-7)
        # A flag that is never set in training has no effect.
        if not part["is_covid"].any():
            assert report["coefficient"][1 + FEATURE_COLS.index("is_covid")] == 0


def test_linear_reports_missing_values(spark):
    frame = spark.createDataFrame([("s", month(i), None, 1.0) for i in range(5)], "series_id string, ds date, x double, y double")
    assert fit_linear(frame, ("x",), "y").first().status == "missing_values"
    rows = [("s", month(i), float(i), None if i == 3 else 1.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "series_id string, ds date, x double, y double")
    assert fit_linear(frame, ("x",), "y").first().status == "missing_values"


# Holt-Winters


def plain_smoothing(y, alpha, beta, gamma):
    first, second = sum(y[:12]) / 12, sum(y[12:24]) / 12
    level, trend, season, sse = first, (second - first) / 12, [v - first for v in y[:12]], 0.0
    for t, v in enumerate(y):
        ahead, due = level + trend, season[t % 12]
        sse += (v - ahead - due) ** 2
        new = alpha * (v - due) + (1 - alpha) * ahead
        trend = beta * (new - level) + (1 - beta) * trend
        season[t % 12] = gamma * (v - ahead) + (1 - gamma) * due
        level = new
    return level, trend, [season[(len(y) + k) % 12] for k in range(12)], sse


def test_smoothing_equals_a_plain_loop(panel):
    for row in smooth(series_arrays(panel, "y"), 0.4, 0.2, 0.3).collect():
        level, trend, season, sse = plain_smoothing(row.y, 0.4, 0.2, 0.3)
        assert math.isclose(row.smoothed.level, level) and math.isclose(row.smoothed.trend, trend)
        assert np.allclose(row.smoothed.season, season) and math.isclose(row.smoothed.sse, sse)


def test_holtwinters_is_exact_on_trend_and_season(make_panel):
    values = [50 + 2 * t + (t % 12) * (5 - t % 12) for t in range(72)]
    params = fit_holtwinters(series_arrays(make_panel({"a": values[:60]}), "y"))
    assert params.first().params["sse"] < 1e-6
    got = [r.yhat for r in predict_holtwinters(params, 12).orderBy("step").collect()]
    assert np.allclose(got, values[60:], atol=1e-3)


def test_holtwinters_fits_better_than_any_grid_point(panel):
    arrays = series_arrays(panel.where("series_id IN ('a', 'b')"), "y")
    fitted = {r.series_id: r.params for r in fit_holtwinters(arrays).collect()}
    for row in arrays.collect():
        tried = [plain_smoothing(row.y, a, b, c)[3] for a in (0.1, 0.4, 0.8) for b in (0.0, 0.1, 0.5) for c in (0.05, 0.2)]
        assert fitted[row.series_id]["sse"] < min(tried)


def test_holtwinters_state_continues_the_recursion(panel):
    # Forecasting from the state equals running on over the fitted one-step values.
    params = fit_holtwinters(series_arrays(panel.where("series_id = 'a'"), "y"))
    state = params.first().state
    got = [r.yhat for r in predict_holtwinters(params, 15).orderBy("step").collect()]
    assert np.allclose(got, [state[0] + k * state[1] + state[2 + (k - 1) % 12] for k in range(1, 16)])
    assert params.first().train_end == month(89)


def test_statuses(make_panel):
    panel = make_panel({"ok": noisy(60, 1), "short": noisy(23, 2), "holes": [*noisy(40, 3), None, 5], "flat": [7] * 40})
    rows = add_exog(panel)
    hw = {r.series_id: r.status for r in fit_holtwinters(rows).collect()}
    assert hw == {"ok": "ok", "short": "too_short", "holes": "missing_values", "flat": "ok"}
    ar = {r.series_id: r.status for r in fit_sarima(rows).collect()}
    assert ar == {"ok": "ok", "short": "too_short", "holes": "missing_values", "flat": "ok"}


# SARIMA


def add_exog(panel):
    flags = panel.withColumns(
        {
            "is_spring_trek": F.col("month").isin(3, 4, 5).cast("int"),
            "is_autumn_trek": F.col("month").isin(9, 10, 11).cast("int"),
            "is_monsoon": F.col("month").isin(6, 7, 8).cast("int"),
            "is_covid": (F.col("year") == 2003).cast("int"),
        }
    )
    return series_arrays(flags, "y", *EXOG_COLS)


def plain_errors(w, ar, sar, ma, sma):
    e = []
    for t in range(len(w)):
        back = lambda xs, k: xs[t - k] if t >= k else 0.0
        e.append(
            w[t] - ar * back(w, 1) - sar * back(w, 12) + ar * sar * back(w, 13)
            - ma * back(e, 1) - sma * back(e, 12) - ma * sma * back(e, 13)
        )
    return e


def differenced(y):
    return [y[t] - y[t - 1] - y[t - 12] + y[t - 13] for t in range(13, len(y))]


def test_error_path_equals_a_plain_loop(spark):
    rng = random.Random(8)
    w = [rng.gauss(0, 1) for _ in range(50)]
    frame = spark.createDataFrame([("s", w)], "series_id string, w array<double>")
    got = error_path(frame, 0.4, 0.3, -0.5, -0.6, values="w").first().errors
    assert np.allclose(got, plain_errors(w, 0.4, 0.3, -0.5, -0.6))


def test_sarima_fit_and_forecast(spark, panel):
    arrays = add_exog(panel.where("series_id IN ('a', 'b', 'short')"))
    params = fit_sarima(arrays).cache()
    fitted = {r.series_id: r for r in params.collect()}
    ahead = spark.createDataFrame(
        [(s, month(len(r) - 1 + k), 0, 0, 0, k % 2) for s, r in ((x.series_id, x.y) for x in arrays.collect()) for k in range(1, 16)],
        "series_id string, ds date, is_spring_trek int, is_autumn_trek int, is_monsoon int, is_covid int",
    )
    got = {(r.series_id, r.step): r.yhat for r in predict_sarima(params, 15, ahead).collect()}
    for row in arrays.collect():
        p = fitted[row.series_id].params
        weights = [p[n] for n in WEIGHTS]
        assert all(abs(v) < 1 for v in weights)
        assert p["is_spring_trek"] == p["is_autumn_trek"] == p["is_monsoon"] == 0
        base = [y - p["is_covid"] * x for y, x in zip(row.y, row.is_covid)]
        w = differenced(base)
        e = plain_errors(w, *weights)
        assert math.isclose(sum(v * v for v in e), p["sse"], rel_tol=1e-9)
        # No small change of the weights fits better.
        for i in range(4):
            for d in (-1e-3, 1e-3):
                moved = [v + d * (j == i) for j, v in enumerate(weights)]
                if all(abs(v) < 0.995 for v in moved):
                    assert sum(v * v for v in plain_errors(w, *moved)) >= p["sse"] * (1 - 1e-5)
        ar, sar, ma, sma = weights
        for k in range(1, 16):
            w.append(ar * w[-1] + sar * w[-12] - ar * sar * w[-13] + ma * e[-1] + sma * e[-12] + ma * sma * e[-13])
            e.append(0.0)
            base.append(w[-1] + base[-1] + base[-12] - base[-13])
            assert math.isclose(got[row.series_id, k], base[-1] + p["is_covid"] * (k % 2), rel_tol=1e-9)


# Network


def test_initial_weights():
    network = Network.seeded((10, 64, 32, 1), seed=3)
    assert [w.shape for w in network.weights] == [(10, 64), (64, 32), (32, 1)]
    assert all((b == 0).all() for b in network.biases)
    assert math.isclose(network.weights[1].var(), 2 / 64, rel_tol=0.1)
    assert (Network.seeded((10, 64, 32, 1), seed=3).flat() == network.flat()).all()
    assert network.flat().size == 10 * 64 + 64 + 64 * 32 + 32 + 32 + 1
    back = network.from_flat(network.flat())
    assert all((a == b).all() for a, b in zip(back.weights, network.weights))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    network = Network.seeded((3, 5, 4, 1), seed=1)
    x, y = rng.normal(size=(7, 3)), rng.normal(size=7)
    slope, loss = gradient(network, x, y)
    flat = network.flat()

    def at(values):
        return ((forward(network.from_flat(values), x)[-1][:, 0] - y) ** 2).mean()

    assert math.isclose(loss, at(flat))
    for i in range(flat.size):
        step = np.zeros(flat.size)
        step[i] = 1e-6
        assert math.isclose(slope[i], (at(flat + step) - at(flat - step)) / 2e-6, abs_tol=1e-6)


def test_expression_batches_and_full_gradient_agree(scaled):
    network = Network.seeded((len(Z_COLS), 8, 5, 1), seed=2)
    both = predict_network(scaled, network).withColumn("native", network_expression(network, F.array(*Z_COLS).cast("array<double>")))
    rows = both.toPandas()
    assert np.allclose(rows["z_yhat"], rows["native"])
    x, y = rows[list(Z_COLS)].to_numpy(float), rows["z_y"].to_numpy(float)
    got = full_gradient(scaled.repartition(5), network).orderBy("pos").toPandas()["gradient"]
    assert np.allclose(got, gradient(network, x, y)[0])


def test_one_task_is_plain_mini_batch_descent(scaled):
    trained = train_network(scaled, QUICK, tasks=1)
    rows = scaled.select("series_id", "ds", "split", *Z_COLS, "z_y").toPandas().sort_values(["series_id", "ds"])
    train, held = rows[rows["split"] == "train"], rows[rows["split"] == "test"]
    x, y = train[list(Z_COLS)].to_numpy(float), train["z_y"].to_numpy(float)
    network = Network.seeded((len(Z_COLS), *QUICK.mlp_hidden, 1), QUICK.seed, QUICK.mlp_learning_rate)
    flat, losses = network.flat(), []
    for number in range(2):
        rng = np.random.default_rng((QUICK.seed, number, 0))
        for _ in range(3):
            order, batch = rng.permutation(len(y)), []
            for at in range(0, len(y), 16):
                chosen = order[at : at + 16]
                slope, loss = gradient(network.from_flat(flat), x[chosen], y[chosen])
                flat = flat - QUICK.mlp_learning_rate * slope
                batch.append(loss)
            miss = forward(network.from_flat(flat), held[list(Z_COLS)].to_numpy(float))[-1][:, 0] - held["z_y"]
            losses.append((np.mean(batch), (miss**2).mean()))
    assert np.allclose(trained.network.flat(), flat, atol=1e-9)
    got = trained.history.orderBy("epoch").collect()
    assert [(r.round, r.epoch) for r in got] == [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (2, 6)]
    assert np.allclose([(r.train_loss, r.val_loss) for r in got], losses, atol=1e-9)


def test_training_over_several_tasks_is_repeatable_and_learns(scaled):
    cfg = replace(QUICK, mlp_epochs=40, mlp_local_epochs=10)
    first, second = (train_network(scaled, cfg, tasks=3) for _ in range(2))
    assert (first.network.flat() == second.network.flat()).all()
    losses = [r.train_loss for r in first.history.orderBy("epoch").collect()]
    assert losses[-1] < losses[0] / 2


# Whole runs


@pytest.fixture(scope="module")
def result(panel):
    return evaluate_models(panel, QUICK)


def test_every_model_is_scored_on_the_held_out_months(result, panel):
    test = split_by_time(add_features(panel, QUICK)).where("split = 'test'")
    months = {(r.series_id, r.ds) for r in test.collect()}
    per_model = {}
    for r in result.forecasts.collect():
        per_model.setdefault(r.model, set()).add((r.series_id, r.ds))
    long = {k for k in months if k[0] in ("a", "b")}
    assert per_model[MLP] == per_model[LINEAR] == months
    assert per_model[SARIMA] == per_model[HOLT_WINTERS] == long
    assert result.metrics.where("mape IS NULL").isEmpty()
    assert result.metrics.count() == 10


def test_saved_models_forecast_the_same(spark, result, panel, tmp_path):
    save_evaluation(result, str(tmp_path))
    loaded = load_models(spark, str(tmp_path))
    want = sorted(map(tuple, forecast_all(panel, result.models, 6, QUICK).collect()))
    assert sorted(map(tuple, forecast_all(panel, loaded, "6", QUICK).collect())) == want
    assert len(want) == 6 * 10
    assert read_losses(spark, str(tmp_path)).count() == QUICK.mlp_epochs
    with pytest.raises(FileNotFoundError):
        load_models(spark, str(tmp_path / "absent"))


def test_labels_are_the_months_the_values_are_for(result, panel):
    """The fit ends 12 months before the data; the first forecast month is its 13th step, not its first."""
    got = {(r.series_id, r.model, r.step): r for r in forecast_all(panel, result.models, 3, QUICK).collect()}
    steps = {r.step: r for r in predict_holtwinters(result.models.params.where("series_id = 'a'"), 15).collect()}
    for k in (1, 2, 3):
        row = got["a", HOLT_WINTERS, k]
        assert row.ds == month(89 + k) == steps[12 + k].ds
        assert row.yhat == max(0, round(steps[12 + k].yhat))
        assert got["a", SARIMA, k].ds == month(89 + k)


def test_status_and_failure(result, panel):
    status = {(r.series_id, r.model): r.status for r in forecast_status(result.models).collect()}
    assert status["short", HOLT_WINTERS] == status["short", SARIMA] == "too_short"
    assert status["a", MLP] == status["short", LINEAR] == "ok"
    nothing = FittedModels(result.models.scaler, result.models.params.where("status <> 'ok'"), None)
    with pytest.raises(RuntimeError):
        forecast_all(panel, nothing, 3, QUICK)
    only_linear = FittedModels(result.models.scaler, result.models.params.where(F.col("model") == LINEAR), None)
    assert {r.model for r in forecast_all(panel, only_linear, 3, QUICK).collect()} == {LINEAR}


def test_a_saved_panel_needs_no_shuffle(spark, panel, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS saved LOCATION '{tmp_path}/db'")
    save_panel(panel, "saved.panel", buckets=4)
    features = standardise(split_by_time(add_features(spark.table("saved.panel"), QUICK)))
    assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()
    assert features.count() == prepare(panel, QUICK).count()
    save_panel(panel, "saved.by_year", buckets=4, by_year=True)
    some = history(spark.table("saved.by_year"), 2001, 2002, ordered=False)
    plan = some.records._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "Exchange" not in plan
    assert some.records.count() == history(panel, 2001, 2002).records.count() > 0
    spark.sql("DROP DATABASE saved CASCADE")


def test_a_pooled_fit_is_one_fit_over_all_rows(scaled):
    train = scaled.where("split = 'train'")
    got = coefficient_report(fit_linear_pooled(train, Z_COLS, "z_y"), Z_COLS).orderBy("position").toPandas()["coefficient"]
    rows = train.select(*Z_COLS, "z_y").toPandas().to_numpy(float)
    want = np.linalg.lstsq(np.c_[np.ones(len(rows)), rows[:, :-1]], rows[:, -1], rcond=None)[0]
    assert np.allclose(got, want, atol=1e-7)


def test_models_without_a_network_can_be_kept(spark, result, tmp_path):
    save_models(FittedModels(result.models.scaler, result.models.params, None), str(tmp_path))
    assert load_models(spark, str(tmp_path), with_network=False).network is None


def test_every_series_has_a_status_and_a_diverging_network_stops_no_other_model(panel):
    tiny = panel.where("series_id = 'a'").orderBy("ds").limit(20).withColumn("series_id", F.lit("tiny"))
    wild = replace(QUICK, mlp_learning_rate=1e6)
    result = evaluate_models(panel.unionByName(tiny), wild)
    status = {(r.series_id, r.model): r.status for r in forecast_status(result.models).collect()}
    models = {LINEAR, SARIMA, HOLT_WINTERS, MLP}
    assert {m: status["tiny", m] for m in models} == dict.fromkeys(models, "too_short")
    assert result.models.network is None and status["a", MLP] == "not_converged"
    assert {r.model for r in result.metrics.collect()} == models - {MLP}
