"""Seasonal ARIMA (1,1,1)(1,1,1,12) with regressors, fitted by conditional least squares."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from monthloom.config import EXOG_COLS, PERIOD, SARIMA, PanelConfig

WEIGHTS = ("ar", "seasonal_ar", "ma", "seasonal_ma")
_LONGEST = PERIOD + 1
_PATH = "struct<w:array<double>,e:array<double>>"


def error_path(arrays: DataFrame, ar: float, seasonal_ar: float, ma: float, seasonal_ma: float, values: str) -> DataFrame:
    """Run the filter with given weights over an array of differenced values, all within Spark expressions.

    Values and errors before the first are 0. Adds ``errors``, one per value.
    """
    zeros = F.array_repeat(F.lit(0.0), _LONGEST)
    start = F.struct(zeros.alias("w"), zeros.alias("e")).cast(_PATH)

    def step(acc: Column, value: Column) -> Column:
        w, e = acc["w"], acc["e"]
        expected = (
            ar * F.element_at(w, -1) + seasonal_ar * F.element_at(w, -12) - ar * seasonal_ar * F.element_at(w, -13)
        ) + (ma * F.element_at(e, -1) + seasonal_ma * F.element_at(e, -12) + ma * seasonal_ma * F.element_at(e, -13))
        return F.struct(
            F.array_append(w, value).alias("w"), F.array_append(e, value - expected).alias("e")
        ).cast(_PATH)

    path = F.aggregate(values, start, step, lambda acc: acc["e"])
    return arrays.withColumn("errors", F.slice(path, F.lit(_LONGEST + 1), F.size(values)))


def fit_sarima(
    arrays: DataFrame, exog: Sequence[str] = EXOG_COLS, cfg: PanelConfig = PanelConfig()
) -> DataFrame:
    """Weights and regressor effects of least squared error per series, as rows of the model table.

    ``state`` holds what a forecast needs: the last 26 values without regressor effects and the last 13 errors.
    """
    usable = F.size("y") >= cfg.sarima_min_rows
    complete = ~F.exists("y", lambda v: v.isNull())
    inputs = [F.col(c).cast("array<double>") for c in ("y", *exog)]
    fitted = arrays.withColumn("fit", F.when(usable & complete, _fit(*inputs)))
    names = (*WEIGHTS, "sse", *exog)
    done = F.col("fit.params").isNotNull()
    status = F.when(~usable, "too_short").when(~complete, "missing_values").when(done, "ok").otherwise("not_converged")
    return fitted.select(
        "series_id",
        F.lit(SARIMA).alias("model"),
        F.when(done, F.map_from_arrays(F.array(*map(F.lit, names)), "fit.params")).alias("params"),
        F.col("fit.state").alias("state"),
        status.alias("status"),
        F.array_max("ds").alias("train_end"),
    )


def predict_sarima(
    params: DataFrame, steps: int, exog_rows: DataFrame, exog: Sequence[str] = EXOG_COLS, skip: str | None = None
) -> DataFrame:
    """Forecast rows ``(series_id, model, step, ds, yhat)`` for those months after ``train_end`` in ``exog_rows``.

    ``skip`` names a column of ``params`` with a number of months to leave out first; steps count from there.
    """
    left_out = F.lit(0) if skip is None else F.col(skip)
    rows = params.where((F.col("status") == "ok") & (F.col("model") == SARIMA))
    path = F.slice(_continued(F.col("state"), F.col("params"), left_out + steps), left_out + 1, steps)
    stepped = rows.select("*", F.posexplode(path).alias("pos", "base"))
    step = F.col("pos") + 1
    dated = stepped.select(
        "series_id", "model", "params", "base", step.alias("step"), F.add_months("train_end", step + left_out).alias("ds")
    )
    joined = dated.join(exog_rows.select("series_id", "ds", *exog), ["series_id", "ds"])
    effects = [F.col("params")[c] * F.col(c) for c in exog]
    return joined.select("series_id", "model", "step", "ds", sum(effects, F.col("base")).alias("yhat"))


def _continued(state: Column, params: Column, steps: Column) -> Column:
    """The values of the next ``steps`` months before regressor effects."""
    ar, seasonal_ar, ma, seasonal_ma = (params[name] for name in WEIGHTS)
    past = F.slice(state, 1, 2 * _LONGEST)

    def differenced(i: Column) -> Column:
        return past[i] - past[i - 1] - past[i - PERIOD] + past[i - PERIOD - 1]

    start = F.struct(
        past.alias("v"),
        F.transform(F.sequence(F.lit(_LONGEST), F.lit(2 * _LONGEST - 1)), differenced).alias("w"),
        F.slice(state, 2 * _LONGEST + 1, _LONGEST).alias("e"),
    )

    def step(acc: Column, _: Column) -> Column:
        v, w, e = acc["v"], acc["w"], acc["e"]
        change = (
            ar * F.element_at(w, -1)
            + seasonal_ar * F.element_at(w, -12)
            - ar * seasonal_ar * F.element_at(w, -13)
            + ma * F.element_at(e, -1)
            + seasonal_ma * F.element_at(e, -12)
            + ma * seasonal_ma * F.element_at(e, -13)
        )
        value = change + F.element_at(v, -1) + F.element_at(v, -12) - F.element_at(v, -13)
        return F.struct(
            F.array_append(v, value).alias("v"),
            F.array_append(w, change).alias("w"),
            F.array_append(e, F.lit(0.0)).alias("e"),
        )

    kind = "struct<v:array<double>,w:array<double>,e:array<double>>"
    values = F.aggregate(
        F.sequence(F.lit(1), steps), start.cast(kind), lambda acc, i: step(acc, i).cast(kind), lambda acc: acc["v"]
    )
    return F.slice(values, F.lit(2 * _LONGEST + 1), steps)


# The fit: damped Gauss-Newton on the errors of the multiplicative form, for many series and several starting
# points at once. Series of different length are padded with zeros in front, which is exactly how the filter
# treats values before the first.

_STARTS = np.arctanh([(0.3, 0.3, -0.5, -0.5), (0.01, 0.01, -0.01, -0.01), (-0.3, -0.3, 0.3, -0.5), (0.5, 0.0, -0.8, -0.8)])
_CHUNK = 256
# Rounds after which a series that has not settled gets no fit. Most settle within 60.
_ROUNDS = 2000


_FIT = T.StructType([T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("params", "state")])


@pandas_udf(_FIT)
def _fit(ys: pd.Series, *exog: pd.Series) -> pd.DataFrame:
    out = [(None, None)] * len(ys)
    lengths = ys.map(len, na_action="ignore").fillna(0).astype(int).to_numpy()
    # Neighbours in length share a chunk, so little of it is padding.
    order = [i for i in np.argsort(lengths, kind="stable") if lengths[i] >= 2 * _LONGEST]
    for at in range(0, len(order), _CHUNK):
        chosen = order[at : at + _CHUNK]
        y = [np.asarray(ys.iloc[i], dtype=float) for i in chosen]
        x = [np.stack([np.asarray(column.iloc[i], dtype=float) for column in exog], axis=-1) for i in chosen]
        width = max(map(len, y)) - _LONGEST
        dy = np.stack([_front_padded(_difference(v), width) for v in y])
        dx = np.stack([_front_padded(_difference(v), width) for v in x])
        weights, effects, errors = _fit_block(dy, dx)
        for row, i in enumerate(chosen):
            sse = (errors[row] ** 2).sum()
            if np.isfinite(sse):
                base = y[row] - x[row] @ effects[row]
                state = np.concatenate([base[-2 * _LONGEST :], errors[row, -_LONGEST:]])
                out[i] = ([*weights[row], sse, *effects[row]], state.tolist())
    return pd.DataFrame(out, columns=["params", "state"])


def _difference(values: np.ndarray) -> np.ndarray:
    change = values[1:] - values[:-1]
    return change[PERIOD:] - change[:-PERIOD]


def _front_padded(values: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([np.zeros((width - len(values), *values.shape[1:])), values])


def _errors(theta: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """Errors ``(..., time)``; the first four of ``theta`` are the weights before tanh, the rest effects."""
    ar, sar, ma, sma = np.moveaxis(np.tanh(theta[..., :4]), -1, 0)
    v = dy - (dx @ theta[..., 4:, None])[..., 0]
    length = v.shape[-1]
    padded = np.concatenate([np.zeros((*v.shape[:-1], _LONGEST)), v], axis=-1)

    def lag(k: int) -> np.ndarray:
        return padded[..., _LONGEST - k : _LONGEST - k + length]

    u = v - ar[..., None] * lag(1) - sar[..., None] * lag(PERIOD) + (ar * sar)[..., None] * lag(_LONGEST)
    u = np.ascontiguousarray(np.moveaxis(u, -1, 0))
    e = np.zeros((_LONGEST + length, *u.shape[1:]))
    both = ma * sma
    for t in range(length):
        e[_LONGEST + t] = u[t] - ma * e[_LONGEST + t - 1] - sma * e[t + 1] - both * e[t]
    return np.moveaxis(e[_LONGEST:], 0, -1)


def _fit_block(dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    # Differencing turns a regressor that repeats every year into zeros; its effect cannot be told and stays 0.
    told = np.flatnonzero((dx != 0).any((0, 1)))
    scale = np.sqrt((dy**2).mean(1))
    scale[~(scale > 0)] = 1.0
    y, x = (dy / scale[:, None])[:, None], dx[:, None][..., told]
    count = 4 + len(told)
    theta = np.zeros((len(dy), len(_STARTS), count))
    theta[..., :4] = _STARTS
    errors = _errors(theta, y, x)
    sse = (errors**2).sum(-1)
    damping, settled = np.full(sse.shape, 1e-2), np.zeros(sse.shape, dtype=bool)
    for _ in range(_ROUNDS):
        # Only series with an unsettled start go on, so a slow one costs its own rounds.
        on = np.flatnonzero(~settled.all(1))
        if not len(on):
            break
        now, y_on, x_on = theta[on], y[on], x[on]
        nudged = now + 1e-6 * np.eye(count)[:, None, None, :]
        slope = np.moveaxis((_errors(nudged, y_on, x_on) - errors[on]) / 1e-6, 0, -1)
        normal = slope.swapaxes(-1, -2) @ slope
        diagonal = np.einsum("...ii->...i", normal)
        damped = normal + np.eye(count) * (damping[on][..., None] * diagonal + 1e-9)[..., None, :]
        move = -np.linalg.solve(damped, slope.swapaxes(-1, -2) @ errors[on][..., None])[..., 0]
        tried = now + np.clip(move, -1, 1)
        tried[..., :4] = np.clip(tried[..., :4], -3, 3)
        new_errors = _errors(tried, y_on, x_on)
        new_sse, old_sse = (new_errors**2).sum(-1), sse[on]
        better = (new_sse < old_sse) & ~settled[on]
        gain = np.where(better, (old_sse - new_sse) / np.maximum(old_sse, 1e-300), 0.0)
        theta[on] = np.where(better[..., None], tried, now)
        errors[on] = np.where(better[..., None], new_errors, errors[on])
        sse[on] = np.where(better, new_sse, old_sse)
        damping[on] = np.clip(np.where(better, damping[on] * 0.3, damping[on] * 5), 1e-9, 1e9)
        settled[on] |= (better & (gain < 1e-10)) | (damping[on] > 1e6)
    best = (np.arange(len(dy)), sse.argmin(1))
    effects = np.zeros((len(dy), dx.shape[-1]))
    effects[:, told] = theta[best][:, 4:] * scale[:, None]
    left = errors[best] * scale[:, None]
    left[~settled[best]] = np.nan
    return np.tanh(theta[best][:, :4]), effects, left
