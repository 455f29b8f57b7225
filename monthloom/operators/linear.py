"""Least squares with intercept, one fit per series, from sums that Spark aggregates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from monthloom.config import LINEAR

INTERCEPT = "intercept"


def fit_linear(train: DataFrame, regressors: Sequence[str], target: str, model: str = LINEAR) -> DataFrame:
    """Coefficients per series as rows of the model table, regressors named without a ``z_`` prefix.

    Spark sums the products of all column pairs; Python only solves one small system per series. A regressor
    that is constant or repeats others gets the smallest coefficients that fit.
    """
    squares = [f"sum(`{a}` * `{b}`)" for i, a in enumerate(regressors) for b in regressors[i:]]
    sums = train.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(_array(f"avg(`{c}`)" for c in regressors)).alias("x_mean"),
        F.avg(target).alias("y_mean"),
        F.expr(_array(squares)).alias("xx"),
        F.expr(_array(f"sum(`{c}` * `{target}`)" for c in regressors)).alias("xy"),
        F.expr(f"count_if({' OR '.join(f'`{c}` IS NULL' for c in (*regressors, target))})").alias("n_missing"),
        F.max("ds").alias("train_end"),
    )
    names = F.array(*[F.lit(n) for n in (INTERCEPT, *map(_plain, regressors))])
    solved = sums.withColumn("coefficients", _solve("n", "x_mean", "y_mean", "xx", "xy"))
    usable = F.col("coefficients").isNotNull() & (F.col("n_missing") == 0)
    return solved.select(
        "series_id",
        F.lit(model).alias("model"),
        F.when(usable, F.map_from_arrays(names, "coefficients")).alias("params"),
        F.lit(None).cast("array<double>").alias("state"),
        F.when(usable, "ok").otherwise("missing_values").alias("status"),
        "train_end",
    )


def fit_linear_pooled(train: DataFrame, regressors: Sequence[str], target: str, series_id: str = "pooled") -> DataFrame:
    """One fit over the rows of all series, as a model table of one row. Tasks send sums, not rows."""
    return fit_linear(train.withColumn("series_id", F.lit(series_id)), regressors, target)


def predict_linear(rows: DataFrame, params: DataFrame, columns: Sequence[str], out: str = "yhat") -> DataFrame:
    """Add the fitted value of each row; coefficients are joined by series."""
    fitted = params.where("status = 'ok'").select("series_id", "params")
    terms = [F.col(c) * F.col("params")[_plain(c)] for c in columns]
    return rows.join(fitted, "series_id").withColumn(out, sum(terms, F.col("params")[INTERCEPT])).drop("params")


def coefficient_report(params: DataFrame, regressors: Sequence[str]) -> DataFrame:
    """Intercept and coefficients as rows ``(series_id, position, feature, coefficient, sign)``."""
    names = (INTERCEPT, *map(_plain, regressors))
    zipped = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"),
        F.array(*[F.col("params")[n] for n in names]).alias("coefficient"),
    )
    rows = params.where("status = 'ok'").select("series_id", F.posexplode(zipped).alias("position", "row"))
    return rows.select(
        "series_id",
        "position",
        F.col("row.feature").alias("feature"),
        F.col("row.coefficient").alias("coefficient"),
        F.when(F.col("row.coefficient") >= 0, "+").otherwise("-").alias("sign"),
    )


def _array(items: Iterable[str]) -> str:
    return f"array({', '.join(items)})"


def _plain(column: str) -> str:
    return column.removeprefix("z_")


@pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(n: pd.Series, x_mean: pd.Series, y_mean: pd.Series, xx: pd.Series, xy: pd.Series) -> pd.Series:
    if n.empty:
        return pd.Series([], dtype=object)
    mean, cross, count = np.stack(x_mean).astype(float), np.stack(xy).astype(float), n.to_numpy(float)[:, None]
    k = mean.shape[1]
    gram = np.zeros((len(n), k, k))
    upper = np.triu_indices(k)
    gram[:, upper[0], upper[1]] = np.stack(xx).astype(float)
    gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
    gram -= count[..., None] * mean[:, :, None] * mean[:, None, :]
    cross = cross - count * mean * y_mean.to_numpy(float)[:, None]
    known = np.isfinite(gram).all((1, 2)) & np.isfinite(cross).all(1)
    gram[~known], cross[~known] = 0.0, 0.0
    # In correlation form, so that what counts as singular does not depend on the units of a regressor.
    spread = np.sqrt(np.maximum(np.einsum("...ii->...i", gram), 0.0))
    spread[~(spread > 0)] = 1.0
    form = gram / (spread[:, :, None] * spread[:, None, :])
    slopes = (np.linalg.pinv(form, rcond=1e-12, hermitian=True) @ (cross / spread)[..., None])[..., 0] / spread
    level = y_mean.to_numpy(float) - (mean * slopes).sum(1)
    return pd.Series([[a, *b] if ok else None for ok, a, b in zip(known, level, slopes)])
