"""The state-space SARIMA: its likelihood against a dense covariance, fits against known weights, forecasts against the filter."""

from __future__ import annotations

import numpy as np
import pytest

from monthloom.operators.statespace import Order, differenced, fit_block, fit_statespace, forecast_statespace, polynomials, profile

ORDERS = [
    (Order(1, 0, 1, 0, 0, 0, 12), [0.5, -0.3]),
    (Order(1, 0, 1, 1, 0, 1, 4), [0.4, 0.3, 0.2, -0.5]),
    (Order(2, 0, 0, 0, 0, 1, 3), [0.3, -0.2, 0.4]),
    (Order(0, 0, 2, 1, 0, 0, 5), [0.5, 0.2, -0.4]),
]


def dense_loglike(order: Order, theta: list[float], y: np.ndarray) -> float:
    """Gaussian log likelihood with the autocovariance of the MA(∞) form, scale concentrated out."""
    c, m = (x[0] for x in polynomials(order, np.asarray([theta], float)))
    n, terms = len(y), 3000
    psi = np.zeros(terms)
    for j in range(terms):
        psi[j] = (m[j] if j < len(m) else 0.0) + sum(c[k - 1] * psi[j - k] for k in range(1, min(j, len(c)) + 1))
    gamma = np.array([psi[: terms - h] @ psi[h:] for h in range(n)])
    cov = gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]
    logdet = np.linalg.slogdet(cov)[1]
    s2 = y @ np.linalg.solve(cov, y) / n
    return -0.5 * (n * np.log(2 * np.pi * s2) + logdet + n)


@pytest.mark.parametrize("order,theta", ORDERS)
def test_stationary_likelihood_equals_dense_covariance(order, theta):
    y = np.random.default_rng(len(theta)).standard_normal(50)
    _, _, _, loglike = profile(order, np.asarray([theta], float), y[None, :, None], np.ones((1, 50), bool), "stationary")
    assert loglike[0] == pytest.approx(dense_loglike(order, theta, y), rel=1e-9)


def airline(n: int, seed: int, ma: float = -0.4, sma: float = -0.6) -> np.ndarray:
    e = np.random.default_rng(seed).standard_normal(n + 13)
    w = e[13:] + ma * e[12:-1] + sma * e[1:-12] + ma * sma * e[:-13]
    y = np.zeros(n)
    for t in range(n):
        y[t] = w[t] + (y[t - 1] if t >= 1 else 0) + (y[t - 12] if t >= 12 else 0) - (y[t - 13] if t >= 13 else 0)
    return y


def test_fit_recovers_weights_with_and_without_a_regressor():
    order = Order(0, 1, 1, 0, 1, 1, 12)
    # 100 seasons, so that the seasonal weight's standard error (about 0.08) is small enough to test against.
    y = airline(1200, 3)
    x = (np.random.default_rng(4).random(1200) < 0.3).astype(float)
    plain = differenced(y[:, None], order)
    weights, effects, _, loglike, settled = fit_block(order, plain[None], np.ones((1, len(plain)), bool))
    assert settled[0] and weights[0] == pytest.approx([-0.4, -0.6], abs=0.16) and effects.shape == (1, 0)
    both = differenced(np.c_[y + 5.0 * x, x], order)
    weights2, effects2, _, loglike2, _ = fit_block(order, both[None], np.ones((1, len(both)), bool))
    assert weights2[0] == pytest.approx(weights[0], abs=1e-3) and effects2[0, 0] == pytest.approx(5.0, abs=0.2)
    # The optimum is no worse than nearby weights.
    for nudge in ([0.05, 0.0], [0.0, -0.05], [-0.05, 0.05]):
        other = profile(order, (weights[0] + nudge)[None], plain[None], np.ones((1, len(plain)), bool))[3]
        assert other[0] <= loglike[0] + 1e-9


def test_series_of_other_lengths_share_a_block():
    order = Order(1, 1, 0, 0, 1, 1, 12)
    ys = [airline(300, 5), airline(120, 6)]
    width = max(map(len, ys)) - 13
    data, observed = np.zeros((2, width, 1)), np.zeros((2, width), bool)
    for k, y in enumerate(ys):
        d = differenced(y[:, None], order)
        data[k, width - len(d) :], observed[k, width - len(d) :] = d, True
    together = fit_block(order, data, observed)
    alone = fit_block(order, data[1:, -len(differenced(ys[1][:, None], order)) :], observed[1:, -len(differenced(ys[1][:, None], order)) :])
    assert together[0][1] == pytest.approx(alone[0][0], abs=1e-6)
    assert together[3][1] == pytest.approx(alone[3][0], rel=1e-9)


def test_spark_fit_statuses_and_forecast(spark):
    import datetime as dt

    def month(i: int) -> dt.date:
        return dt.date(2000 + i // 12, i % 12 + 1, 1)

    y = airline(150, 8) + 1000
    rows = [("long", [month(i) for i in range(150)], y.tolist(), [float(i % 5 == 0) for i in range(150)])]
    rows.append(("short", [month(i) for i in range(20)], y[:20].tolist(), [0.0] * 20))
    rows.append(("gap", [month(i) for i in range(150)], [None, *y[1:].tolist()], [0.0] * 150))
    arrays = spark.createDataFrame(rows, "series_id string, ds array<date>, y array<double>, flag array<double>")
    order = Order(0, 1, 1, 0, 1, 1, 12)
    for exog in ((), ("flag",)):
        fitted = fit_statespace(arrays, order, exog).cache()
        status = {r.series_id: r.status for r in fitted.collect()}
        assert status == {"long": "ok", "short": "too_short", "gap": "missing_values"}
        future = spark.createDataFrame([("long", month(150 + i), 0.0) for i in range(6)], "series_id string, ds date, flag double")
        got = forecast_statespace(fitted, 6, future, order, exog).orderBy("step").collect()
        assert [r.step for r in got] == list(range(1, 7))
        # The first step by hand: the predicted change of the differenced series, put back on the last levels.
        params = fitted.where("series_id = 'long'").first().params
        level = y - (np.array([float(i % 5 == 0) for i in range(150)]) * params["flag"] if exog else 0)
        one = differenced(np.r_[level, 0.0][:, None], order)[-1, 0]
        state = fitted.where("series_id = 'long'").first().state
        assert got[0].yhat == pytest.approx(state[0] + (level[-1] + level[-12] - level[-13]) + 0 * one, rel=1e-9)
