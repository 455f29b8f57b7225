"""Seasonal ARIMA of any order, with or without regressors, fitted by exact Gaussian likelihood through a Kalman filter.

The series and its regressors are differenced by ``(1 - B)^d (1 - B^s)^D`` first; what is left is a regression with
ARMA errors. The lag polynomials ``φ(B)Φ(B^s)`` and ``θ(B)Θ(B^s)`` are multiplied out once per order and the product
drives a state-space form with state ``r = max(p + sP, q + sQ + 1)``: the transition is the AR coefficients in the
first column and ones above the diagonal, so each step costs ``O(r²)``, not ``O(r³)``. The filter starts diffuse
(variance ``1e6``; the first ``r`` innovations carry no likelihood) or from the stationary covariance.

Kalman gains do not depend on the data, so one pass filters the series and every regressor at once; the regression
effects then follow by generalised least squares and the scale is concentrated out. What remains is a function of the
ARMA weights alone, ``n log σ̂² + Σ log F_t``, written as a sum of squares ``Σ (v_t / √F_t)² · (Π F_t)^{1/n}`` and minimised
by damped Gauss-Newton for many series and several starting points at once. Weights are not bounded (neither
stationarity nor invertibility is enforced).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFFUSE = 1e6
_CHUNK = 128
_ROUNDS = 300


@dataclass(frozen=True)
class Order:
    """(p, d, q)(P, D, Q, s)."""

    p: int = 1
    d: int = 1
    q: int = 1
    P: int = 1
    D: int = 1
    Q: int = 1
    s: int = 12

    @property
    def names(self) -> tuple[str, ...]:
        parts = [("ar", self.p), ("seasonal_ar", self.P), ("ma", self.q), ("seasonal_ma", self.Q)]
        return tuple(f"{name}.{i}" for name, count in parts for i in range(1, count + 1))

    @property
    def states(self) -> int:
        return max(self.p + self.s * self.P, self.q + self.s * self.Q + 1)

    @property
    def label(self) -> str:
        return f"({self.p},{self.d},{self.q})({self.P},{self.D},{self.Q},{self.s})"

    def difference(self) -> np.ndarray:
        """Coefficients of ``(1 - B)^d (1 - B^s)^D``, lowest power first."""
        poly = np.ones(1)
        for _ in range(self.d):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.D):
            poly = np.convolve(poly, np.r_[1.0, np.zeros(self.s - 1), -1.0])
        return poly


def differenced(values: np.ndarray, order: Order) -> np.ndarray:
    """``(1 - B)^d (1 - B^s)^D`` of values along the first axis; as many fewer rows as the polynomial's degree."""
    poly = order.difference()
    lags = len(poly) - 1
    return sum(c * values[lags - k : len(values) - k] for k, c in enumerate(poly))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of batched polynomials, lowest power first."""
    out = np.zeros((len(a), a.shape[1] + b.shape[1] - 1))
    for i in range(a.shape[1]):
        out[:, i : i + b.shape[1]] += a[:, i, None] * b
    return out


def polynomials(order: Order, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """AR coefficients ``c`` (x_t = Σ c_k x_{t-k} + ...) and MA coefficients ``m`` (... + e_t + Σ m_k e_{t-k}), both of length r."""
    n = len(theta)
    at = np.cumsum([0, order.p, order.P, order.q, order.Q])
    ar, sar, ma, sma = (theta[:, at[i] : at[i + 1]] for i in range(4))

    def seasonal(w: np.ndarray, sign: float) -> np.ndarray:
        poly = np.zeros((n, order.s * w.shape[1] + 1))
        poly[:, 0] = 1.0
        poly[:, order.s :: order.s] = sign * w
        return poly

    phi = _times(np.c_[np.ones(n), -ar], seasonal(sar, -1.0))
    psi = _times(np.c_[np.ones(n), ma], seasonal(sma, 1.0))
    r = order.states
    c, m = np.zeros((n, r)), np.zeros((n, r))
    c[:, : phi.shape[1] - 1] = -phi[:, 1:]
    m[:, 0] = 1.0
    m[:, 1 : psi.shape[1]] = psi[:, 1:]
    return c, m


def _advance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Transition times ``x`` (batch, r, k): row i is c_i x_0 + x_{i+1}."""
    out = c[:, :, None] * x[:, :1, :]
    out[:, :-1] += x[:, 1:]
    return out


def stationary_covariance(c: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P with P = T P T' + R R', by the linear system of its entries; for stationary weights only."""
    n, r = c.shape
    t = np.zeros((n, r, r))
    t[:, :, 0] = c
    t[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    kron = np.einsum("bij,bkl->bikjl", t, t).reshape(n, r * r, r * r)
    rr = (m[:, :, None] * m[:, None, :]).reshape(n, r * r)
    return np.linalg.solve(np.eye(r * r) - kron, rr[..., None])[..., 0].reshape(n, r, r)


def kalman(order: Order, theta: np.ndarray, data: np.ndarray, observed: np.ndarray, start: str = "diffuse"):
    """Innovations ``v`` (batch, time, columns), their variances ``F`` (batch, time) with scale 1, whether each step counts
    for the likelihood, and the predicted state after the last step (batch, r, columns).

    Steps before a series' first observation (padding in front of shorter series) leave its start as it is.
    """
    c, m = polynomials(order, theta)
    n, length, cols = data.shape
    r = order.states
    rr = m[:, :, None] * m[:, None, :]
    p = stationary_covariance(c, m) if start == "stationary" else np.broadcast_to(np.eye(r) * DIFFUSE, (n, r, r)).copy()
    burn = r if start == "diffuse" else 0
    a = np.zeros((n, r, cols))
    v = np.zeros((n, length, cols))
    f = np.ones((n, length))
    counts = np.zeros((n, length), dtype=bool)
    seen = np.zeros(n, dtype=int)
    for t in range(length):
        obs = observed[:, t]
        var = p[:, 0, 0]
        safe = np.where(obs & (var > 0), var, 1.0)
        step = data[:, t, :] - a[:, 0, :]
        gain = np.where(obs[:, None], p[:, :, 0] / safe[:, None], 0.0)
        a = a + gain[:, :, None] * step[:, None, :]
        p = p - gain[:, :, None] * p[:, None, 0, :]
        v[:, t] = np.where(obs[:, None], step, 0.0)
        f[:, t] = safe
        counts[:, t] = obs & (seen >= burn)
        seen += obs
        # Until a series' first observation its start stays as it is: padding in front must not age it.
        begun = (seen > 0)[:, None, None]
        a = np.where(begun, _advance(a, c), a)
        moved = _advance(_advance(p, c).swapaxes(1, 2), c) + rr
        p = np.where(begun, 0.5 * (moved + moved.swapaxes(1, 2)), p)
    return v, f, counts, a


def profile(order: Order, theta: np.ndarray, data: np.ndarray, observed: np.ndarray, start: str = "diffuse"):
    """Scaled residuals whose sum of squares is monotone in minus the concentrated log likelihood; effects; σ̂²; log likelihood."""
    v, f, used, _ = kalman(order, theta, data, observed, start)
    w = used / f
    vy, vx = v[..., 0], v[..., 1:]
    gram = np.einsum("bt,bti,btj->bij", w, vx, vx) + 1e-12 * np.eye(vx.shape[-1])
    effects = np.linalg.solve(gram, np.einsum("bt,bti,bt->bi", w, vx, vy)[..., None])[..., 0]
    left = vy - np.einsum("bti,bi->bt", vx, effects)
    count = np.maximum(used.sum(1), 1)
    sigma2 = (w * left**2).sum(1) / count
    logdet = np.where(used, np.log(f), 0.0).sum(1)
    loglike = -0.5 * (count * np.log(2 * np.pi * sigma2) + logdet + count)
    scaled = left * np.sqrt(w) * np.exp(logdet / (2 * count))[:, None]
    return scaled, effects, sigma2, loglike


def _starts(order: Order) -> np.ndarray:
    rows = []
    for ar, ma in ((0.0, 0.0), (0.3, -0.5), (-0.3, 0.3)):
        rows.append([ar] * (order.p + order.P) + [ma] * (order.q + order.Q))
    return np.array(rows)


def fit_block(order: Order, data: np.ndarray, observed: np.ndarray, rounds: int = _ROUNDS):
    """Weights of highest likelihood per series from several starts: (weights, effects, σ̂², log likelihood, settled)."""
    n, count = len(data), len(order.names)
    starts = _starts(order)
    s = len(starts)
    scale = np.sqrt(np.where(observed, data[..., 0] ** 2, 0.0).sum(1) / np.maximum(observed.sum(1), 1))
    scale[~(scale > 0)] = 1.0
    data = data.copy()
    data[..., 0] /= scale[:, None]
    pick = np.repeat(np.arange(n), s)
    theta = np.tile(starts, (n, 1))

    def residuals(th: np.ndarray, rows: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return profile(order, th, data[rows], observed[rows])[0]

    errors = residuals(theta, pick)
    sse = np.where(np.isfinite(errors).all(1), (errors**2).sum(1), np.inf)
    damping, settled = np.full(n * s, 1e-2), np.zeros(n * s, dtype=bool)
    for _ in range(rounds if count else 0):
        on = np.flatnonzero(~settled)
        if not len(on):
            break
        now = theta[on]
        nudged = (now[:, None, :] + 1e-6 * np.eye(count)).reshape(-1, count)
        slope = (residuals(nudged, np.repeat(pick[on], count)).reshape(len(on), count, -1) - errors[on][:, None]) / 1e-6
        slope = np.nan_to_num(slope.swapaxes(1, 2))
        normal = slope.swapaxes(1, 2) @ slope
        diagonal = np.einsum("bii->bi", normal)
        damped = normal + np.eye(count) * (damping[on][:, None] * diagonal + 1e-9)[:, None, :]
        move = -np.linalg.solve(damped, slope.swapaxes(1, 2) @ np.nan_to_num(errors[on])[..., None])[..., 0]
        tried = now + move
        new_errors = residuals(tried, pick[on])
        new_sse = np.where(np.isfinite(new_errors).all(1), (new_errors**2).sum(1), np.inf)
        better = new_sse < sse[on]
        gain = np.where(better, (sse[on] - new_sse) / np.maximum(sse[on], 1e-300), 0.0)
        theta[on] = np.where(better[:, None], tried, now)
        errors[on] = np.where(better[:, None], new_errors, errors[on])
        sse[on] = np.where(better, new_sse, sse[on])
        damping[on] = np.clip(np.where(better, damping[on] * 0.3, damping[on] * 5), 1e-9, 1e9)
        settled[on] |= (better & (gain < 1e-10)) | (damping[on] > 1e6)
    best = sse.reshape(n, s).argmin(1) + np.arange(n) * s
    weights = theta[best]
    with np.errstate(all="ignore"):
        _, effects, sigma2, loglike = profile(order, weights, data, observed)
    loglike = loglike - observed_count(order, observed) * np.log(scale)
    return weights, effects * scale[:, None], sigma2 * scale**2, loglike, settled[best] | (count == 0)


def observed_count(order: Order, observed: np.ndarray) -> np.ndarray:
    burn = order.states
    return np.maximum(observed.sum(1) - burn, 0)


def _state(order: Order, weights: np.ndarray, effects: np.ndarray, data: np.ndarray, observed: np.ndarray, levels: list) -> list:
    """What a forecast needs: the predicted state of the differenced series less its effects, and the last levels less effects."""
    _, _, _, a = kalman(order, weights, data, observed)
    base = a[:, :, 0] - np.einsum("brk,bk->br", a[:, :, 1:], effects)
    lags = len(order.difference()) - 1
    return [np.r_[base[i], levels[i][len(levels[i]) - lags :]].tolist() for i in range(len(levels))]


_FIT = T.StructType(
    [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("weights", "effects", "state")]
    + [T.StructField(c, T.DoubleType()) for c in ("sigma2", "loglike")]
    + [T.StructField("settled", T.BooleanType())]
)


def _fitter(order: Order, regressors: int):
    @F.pandas_udf(_FIT)
    def run(ys: pd.Series, *exog: pd.Series) -> pd.DataFrame:
        out = [(None, None, None, None, None, None)] * len(ys)
        lags = len(order.difference()) - 1
        least = lags + order.states + len(order.names) + regressors + 1
        lengths = ys.map(len, na_action="ignore").fillna(0).astype(int).to_numpy()
        chosen = [i for i in np.argsort(lengths, kind="stable") if lengths[i] >= least]
        for at in range(0, len(chosen), _CHUNK):
            rows = chosen[at : at + _CHUNK]
            y = [np.asarray(ys.iloc[i], dtype=float) for i in rows]
            x = [np.stack([np.asarray(c.iloc[i], dtype=float) for c in exog], -1) if exog else np.zeros((len(y[k]), 0)) for k, i in enumerate(rows)]
            width = max(map(len, y)) - lags
            data = np.zeros((len(rows), width, 1 + regressors))
            observed = np.zeros((len(rows), width), dtype=bool)
            for k in range(len(rows)):
                both = differenced(np.c_[y[k], x[k]], order)
                data[k, width - len(both) :] = both
                observed[k, width - len(both) :] = True
            weights, effects, sigma2, loglike, settled = fit_block(order, data, observed)
            levels = [y[k] - x[k] @ effects[k] for k in range(len(rows))]
            with np.errstate(all="ignore"):
                states = _state(order, weights, effects, data, observed, levels)
            for k, i in enumerate(rows):
                good = np.isfinite(loglike[k]) and np.isfinite(weights[k]).all()
                out[i] = (weights[k].tolist(), effects[k].tolist(), states[k], float(sigma2[k]), float(loglike[k]), bool(good and settled[k]))
        return pd.DataFrame(out, columns=["weights", "effects", "state", "sigma2", "loglike", "settled"])

    return run


def fit_statespace(arrays: DataFrame, order: Order = Order(), exog: Sequence[str] = (), model: str = "SARIMA") -> DataFrame:
    """One row per series of ``arrays`` (series_id, ds, y and ``exog`` as arrays in month order): the model table row.

    ``params`` holds the weights by name, ``sigma2``, ``loglike``, ``aic`` and each regressor's effect (0 where differencing
    leaves nothing of it). Series with a null value or too short for the order get no params and say so in ``status``;
    a fit that did not settle says ``not_converged``. ``state`` is what ``forecast_statespace`` goes on from.
    """
    names = [*order.names, "sigma2", "loglike", "aic", *exog]
    lags = len(order.difference()) - 1
    least = lags + order.states + len(order.names) + len(exog) + 1
    complete = ~F.exists("y", lambda v: v.isNull())
    for c in exog:
        complete = complete & ~F.exists(c, lambda v: v.isNull())
    inputs = [F.col(c).cast("array<double>") for c in ("y", *exog)]
    fitted = arrays.withColumn("fit", F.when(complete & (F.size("y") >= least), _fitter(order, len(exog))(*inputs)))
    aic = -2 * F.col("fit.loglike") + 2 * (len(order.names) + len(exog) + 1)
    values = F.concat(
        "fit.weights", F.array(F.col("fit.sigma2"), F.col("fit.loglike"), aic), "fit.effects"
    )
    usable = F.col("fit.settled").isNotNull()
    status = (
        F.when(F.size("y") < least, "too_short").when(~complete, "missing_values")
        .when(F.col("fit.settled"), "ok").otherwise("not_converged")
    )
    return arrays.select("series_id").join(fitted, "series_id").select(
        "series_id",
        F.lit(model).alias("model"),
        F.lit(order.label).alias("order"),
        F.when(usable, F.map_from_arrays(F.array(*map(F.lit, names)), values)).alias("params"),
        F.col("fit.state").alias("state"),
        status.alias("status"),
        F.array_max("ds").alias("train_end"),
    )


def _ahead(order: Order, steps: int):
    @F.pandas_udf("array<double>")
    def run(states: pd.Series, weights: pd.Series) -> pd.Series:
        r, poly = order.states, order.difference()
        out = []
        for state, w in zip(states, weights):
            state, w = np.asarray(state, float), np.asarray(w, float)
            c, _ = polynomials(order, w[None])
            a, levels = state[:r][None, :, None], list(state[r:])
            path = []
            for _ in range(steps):
                change = a[0, 0, 0]
                level = change - sum(poly[k] * levels[-k] for k in range(1, len(poly)))
                levels.append(level)
                path.append(level)
                a = _advance(a, c)
            out.append(path)
        return pd.Series(out)

    return run


def forecast_statespace(
    params: DataFrame, steps: int, exog_rows: DataFrame, order: Order = Order(), exog: Sequence[str] = ()
) -> DataFrame:
    """Forecast rows (series_id, model, step, ds, yhat) for the ``steps`` months after ``train_end`` found in ``exog_rows``."""
    rows = params.where(F.col("status") == "ok").where(F.col("order") == order.label)
    weights = F.array(*[F.col("params")[n] for n in order.names]) if order.names else F.array().cast("array<double>")
    path = _ahead(order, steps)(F.col("state"), weights)
    stepped = rows.select("*", F.posexplode(path).alias("pos", "base"))
    step = F.col("pos") + 1
    dated = stepped.select("series_id", "model", "params", "base", step.alias("step"), F.add_months("train_end", step).alias("ds"))
    joined = dated.join(exog_rows.select("series_id", "ds", *exog), ["series_id", "ds"])
    effects = [F.col("params")[c] * F.col(c) for c in exog]
    return joined.select("series_id", "model", "step", "ds", sum(effects, F.col("base")).alias("yhat"))


def likelihood_fixed(arrays: DataFrame, weights: Sequence[float], order: Order, values: str = "y", start: str = "diffuse") -> DataFrame:
    """Innovations and their variances (scale 1) per month of already differenced ``values`` for given weights.

    Adds ``innovations``, ``variances`` and ``counted`` (whether a step enters the likelihood), one per value.
    """

    @F.pandas_udf("struct<innovations:array<double>,variances:array<double>,counted:array<boolean>>")
    def run(ys: pd.Series) -> pd.DataFrame:
        out = []
        for y in ys:
            y = np.asarray(y, float)
            v, f, used, _ = kalman(order, np.asarray([weights], float), y[None, :, None], np.ones((1, len(y)), bool), start)
            out.append((v[0, :, 0].tolist(), f[0].tolist(), used[0].tolist()))
        return pd.DataFrame(out, columns=["innovations", "variances", "counted"])

    return arrays.withColumn("k", run(F.col(values).cast("array<double>"))).select("*", "k.*").drop("k")


def with_status(fitted: DataFrame) -> Column:
    return F.col("status")
