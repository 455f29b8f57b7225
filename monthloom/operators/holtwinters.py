"""Additive exponential smoothing with trend and a season of twelve months."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from monthloom.config import HOLT_WINTERS, PERIOD, PanelConfig

_STATE = "struct<level:double,trend:double,season:array<double>,sse:double>"


def smooth(arrays: DataFrame, alpha: float, beta: float, gamma: float, values: str = "y") -> DataFrame:
    """Run the recursion with given weights over each series' array, all within Spark expressions.

    The start comes from the first two years: mean of the first, mean step from the first to the second, and the
    first year's distances from its mean. Adds ``smoothed``: level, trend, the next twelve seasonal terms and the
    sum of squared errors.
    """
    ys = F.transform(values, lambda v: v.cast("double"))

    def mean(year: Column) -> Column:
        return F.aggregate(year, F.lit(0.0), lambda acc, v: acc + v) / PERIOD

    first, second = mean(F.slice(ys, 1, PERIOD)), mean(F.slice(ys, PERIOD + 1, PERIOD))
    start = F.struct(
        first.alias("level"),
        ((second - first) / PERIOD).alias("trend"),
        F.transform(F.slice(ys, 1, PERIOD), lambda v: v - first).alias("season"),
        F.lit(0.0).alias("sse"),
    ).cast(_STATE)

    def step(acc: Column, y: Column) -> Column:
        ahead, due = acc["level"] + acc["trend"], acc["season"][0]
        level = alpha * (y - due) + (1 - alpha) * ahead
        renewed = gamma * (y - ahead) + (1 - gamma) * due
        return F.struct(
            level.alias("level"),
            (beta * (level - acc["level"]) + (1 - beta) * acc["trend"]).alias("trend"),
            F.concat(F.slice(acc["season"], 2, PERIOD - 1), F.array(renewed)).alias("season"),
            (acc["sse"] + (y - ahead - due) * (y - ahead - due)).alias("sse"),
        ).cast(_STATE)

    long_enough = arrays.where(F.size(values) >= 2 * PERIOD)
    return long_enough.withColumn("smoothed", F.aggregate(ys, start, step))


def smoothed_forecast(smoothed: DataFrame, steps: int) -> DataFrame:
    """Forecast rows from the states of :func:`smooth`."""
    s, step = F.col("smoothed"), F.col("step")
    rows = smoothed.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    seasonal = F.get(s["season"], (step - 1) % PERIOD)
    return rows.withColumn("yhat", s["level"] + step * s["trend"] + seasonal)


def fit_holtwinters(arrays: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Weights and start state of least squared error per series, as rows of the model table.

    ``state`` holds level, trend and the next twelve seasonal terms.
    """
    usable = F.size("y") >= cfg.hw_min_rows
    complete = ~F.exists("y", lambda v: v.isNull())
    fitted = arrays.withColumn("fit", F.when(usable & complete, _fit(F.col("y").cast("array<double>"))))
    names = ("alpha", "beta", "gamma", "sse")
    params = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"fit.{n}") for n in names]))
    done = F.col("fit.sse").isNotNull()
    status = F.when(~usable, "too_short").when(~complete, "missing_values").when(done, "ok").otherwise("not_converged")
    return fitted.select(
        "series_id",
        F.lit(HOLT_WINTERS).alias("model"),
        F.when(done, params).alias("params"),
        F.col("fit.state").alias("state"),
        status.alias("status"),
        F.array_max("ds").alias("train_end"),
    )


def predict_holtwinters(params: DataFrame, steps: int, skip: str | None = None) -> DataFrame:
    """Forecast rows ``(series_id, model, step, ds, yhat)`` for the months after ``train_end``.

    ``skip`` names a column of ``params`` with a number of months to leave out first; steps count from there.
    """
    left_out = F.lit(0) if skip is None else F.col(skip)
    rows = params.where((F.col("status") == "ok") & (F.col("model") == HOLT_WINTERS))
    stepped = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    state, ahead = F.col("state"), F.col("step") + left_out
    yhat = state[0] + ahead * state[1] + F.get(state, 2 + (ahead - 1) % PERIOD)
    return stepped.select("series_id", "model", "step", F.add_months("train_end", ahead).alias("ds"), yhat.alias("yhat"))


# The fit. Errors of the recursion are linear in the start state, so for given weights the best start state is a
# least-squares solution, and only the three weights have to be searched: a grid first, then ever smaller steps
# around the best point. All series of one length go through NumPy together.

_FREE = PERIOD + 1  # level, trend and eleven seasonal terms; the twelfth is fixed at 0, the level takes it up
_LOWEST, _FINEST_STEP = 1e-4, 5e-4
_CHUNK = 64
# Rounds after which a series that has not settled gets no fit. Most settle within 80.
_ROUNDS = 5000
_NEIGHBOURS = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)], dtype=float)


_FIT = T.StructType(
    [T.StructField(c, T.DoubleType()) for c in ("alpha", "beta", "gamma", "sse")]
    + [T.StructField("state", T.ArrayType(T.DoubleType()))]
)


@pandas_udf(_FIT)
def _fit(ys: pd.Series) -> pd.DataFrame:
    out = [(None, None, None, None, None)] * len(ys)
    lengths = ys.map(len, na_action="ignore").fillna(0).astype(int).to_numpy()
    for length in np.unique(lengths[lengths >= 2 * PERIOD]):
        same, grid = np.flatnonzero(lengths == length), _grid_for(length)
        for at in range(0, len(same), _CHUNK):
            chosen = same[at : at + _CHUNK]
            weights, sse, state = _fit_block(np.stack(ys.iloc[chosen]).astype(float), *grid)
            for i, w, error, s in zip(chosen, weights, sse, state):
                if np.isfinite(error):
                    out[i] = (*w, error, s.tolist())
    return pd.DataFrame(out, columns=["alpha", "beta", "gamma", "sse", "state"])


def _fit_block(y: np.ndarray, grid: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Errors from a zero start for every grid point and series, less what a start state can explain.
    errors = _errors(y.T[:, None, :], grid[:, None, :], np.zeros((PERIOD + 2, 1, 1)))[0]
    errors = errors.transpose(1, 0, 2)
    left = (errors**2).sum(1) - ((bases.transpose(0, 2, 1) @ errors) ** 2).sum(1)
    best = grid[left.argmin(0)]
    sse, start = _concentrated(y, best[:, None, :])
    sse, start = sse[:, 0], start[:, 0]
    reach = np.full(len(y), 0.05)
    rows = np.arange(len(y))
    for _ in range(_ROUNDS):
        active = reach >= _FINEST_STEP
        if not active.any():
            break
        around = _feasible(best[active, None, :] + reach[active, None, None] * _NEIGHBOURS)
        tried, starts = _concentrated(y[active], around)
        pick = tried.argmin(1)
        at, local = rows[active], np.arange(active.sum())
        better = tried[local, pick] < sse[active] * (1 - 1e-12)
        moved = at[better]
        best[moved], sse[moved] = around[local, pick][better], tried[local, pick][better]
        start[moved] = starts[local, pick][better]
        reach[at[~better]] /= 2
    sse[reach >= _FINEST_STEP] = np.nan
    full = np.concatenate([start, np.zeros((len(y), 1))], axis=1)
    _, level, trend, season = _errors(y.T, best, full.T)
    turned = np.roll(np.stack(season, axis=-1), -(y.shape[1] % PERIOD), axis=-1)
    return best, sse, np.concatenate([level[:, None], trend[:, None], turned], axis=1)


def _errors(y: np.ndarray, weights: np.ndarray, start: np.ndarray):
    """One-step errors ``(time, ...)`` and the final level, trend and seasonal terms.

    ``weights`` ends in (alpha, beta, gamma); ``y[t]``, ``start[i]`` and the rest of ``weights`` broadcast.
    """
    alpha, beta, gamma = weights[..., 0], weights[..., 1], weights[..., 2]
    shape = np.broadcast_shapes(y.shape[1:], alpha.shape, start.shape[1:])
    level, trend, *season = [np.broadcast_to(s, shape) for s in start]
    out = np.empty((len(y), *shape))
    for t in range(len(y)):
        error = y[t] - level - trend - season[t % PERIOD]
        level = level + trend + alpha * error
        trend = trend + alpha * beta * error
        season[t % PERIOD] = season[t % PERIOD] + gamma * error
        out[t] = error
    return out, level, trend, season


def _concentrated(y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least squared error and best start state per series and candidate: ``(b, c)`` and ``(b, c, 13)``."""
    series = np.zeros((y.shape[1], len(y), 1, _FREE + 1))
    series[:, :, 0, -1] = y.T
    units = np.zeros((PERIOD + 2, 1, 1, _FREE + 1))
    units[np.arange(_FREE), 0, 0, np.arange(_FREE)] = 1.0
    errors = _errors(series, weights[:, :, None, :], units)[0].transpose(1, 2, 0, 3)
    effect, zero_start = errors[..., :-1], errors[..., -1:]
    gram = effect.swapaxes(-1, -2) @ effect
    gram[..., np.arange(_FREE), np.arange(_FREE)] *= 1 + 1e-10
    start = -np.linalg.solve(gram, effect.swapaxes(-1, -2) @ zero_start)
    return ((zero_start + effect @ start) ** 2).sum((-1, -2)), start[..., 0]


def _feasible(weights: np.ndarray) -> np.ndarray:
    """Weights inside (0, 1) with gamma no more than 1 - alpha."""
    inside = np.clip(weights, _LOWEST, 1 - _LOWEST)
    inside[..., 2] = np.minimum(inside[..., 2], np.maximum(1 - inside[..., 0], _LOWEST))
    return inside


def _grid_for(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid points, and for each an orthonormal basis of the errors that start states can produce."""
    levels = (_LOWEST, 0.1, 0.25, 0.4, 0.55, 0.7, 0.85)
    grid = np.array([(a, b, c) for a in levels[1:] for b in levels for c in levels if c <= 1 - a])
    units = np.zeros((PERIOD + 2, 1, _FREE))
    units[np.arange(_FREE), 0, np.arange(_FREE)] = 1.0
    effect = _errors(np.zeros((length, 1, 1)), grid[:, None, :], units)[0].transpose(1, 0, 2)
    return grid, np.linalg.qr(effect)[0]
