"""Least squares with intercept by orthogonal reduction: triangular factors per task, merged by series.

Each task reduces the rows it holds, series by series and batch by batch, to a count, the column means and the upper
triangular factor ``R`` of the centred block ``[X - x̄, y - ȳ]`` (Householder QR). Two such summaries merge exactly:

    R = qr([R_a; R_b; √(n_a n_b / (n_a + n_b)) · (mean_a - mean_b)]),  mean = (n_a mean_a + n_b mean_b) / (n_a + n_b)

so partial factors are merged by key in two rounds (by series and a slot of at most ``fan_in`` partials, then by
series), and no group holds more than ``fan_in`` small factors, however many rows a series has. Neither sums of
squares nor cross products of raw columns are ever formed, so columns whose mean is far from their spread (dates in
seconds, say) lose no digits. The slopes solve the triangle ``R_xx β = r_xy``; the intercept is ``ȳ - x̄ β``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.config import LINEAR

INTERCEPT = "intercept"
PARTIAL = "series_id string, n long, missing long, end date, mean array<double>, r array<double>"


def reduce_block(block: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, column means and upper triangular factor of the centred rows of ``block`` (rows × columns)."""
    mean = block.mean(0)
    r = np.linalg.qr(block - mean, mode="r")
    width = block.shape[1]
    square = np.zeros((width, width))
    square[: r.shape[0]] = r
    return len(block), mean, square


def merge(parts: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """One summary of several (count, means, factor) summaries."""
    parts = [p for p in parts if p[0] > 0]
    n, mean, r = parts[0]
    for m, other_mean, other_r in parts[1:]:
        gap = np.sqrt(n * m / (n + m)) * (mean - other_mean)
        stacked = np.linalg.qr(np.vstack([r, other_r, gap]), mode="r")
        mean = (n * mean + m * other_mean) / (n + m)
        n, r = n + m, stacked[: len(mean)]
    return n, mean, r


def solve(n: int, mean: np.ndarray, r: np.ndarray, rcond: float = 1e-12) -> tuple[np.ndarray, float]:
    """Intercept and slopes from a summary, and the residual sum of squares; slopes of a rank-deficient part are 0."""
    k = len(mean) - 1
    rxx, rxy = r[:k, :k], r[:k, k]
    scale = np.abs(np.diag(rxx))
    kept = scale > rcond * max(scale.max(initial=0.0), 1e-300)
    slopes = np.zeros(k)
    if kept.any():
        slopes[kept] = np.linalg.lstsq(rxx[np.ix_(kept, kept)], rxy[kept], rcond=None)[0]
    residual = float(r[k, k] ** 2 + np.sum((rxy[~kept]) ** 2) if (~kept).any() else r[k, k] ** 2)
    return np.r_[mean[k] - mean[:k] @ slopes, slopes], residual


def _partials(columns: Sequence[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for series, part in batch.groupby("series_id", sort=False):
                values = part[list(columns)].to_numpy(float)
                good = np.isfinite(values).all(1)
                end = part["ds"].max()
                n, mean, r = reduce_block(values[good]) if good.any() else (0, np.zeros(len(columns)), np.zeros((len(columns),) * 2))
                rows.append((series, n, int((~good).sum()), end, mean.tolist(), r.ravel().tolist()))
            yield pd.DataFrame(rows, columns=["series_id", "n", "missing", "end", "mean", "r"])

    return run


def _merged(width: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        summaries = [
            (int(n), np.asarray(m, float), np.asarray(r, float).reshape(width, width))
            for n, m, r in zip(parts["n"], parts["mean"], parts["r"])
        ]
        live = [s for s in summaries if s[0] > 0]
        n, mean, r = merge(live) if live else (0, np.zeros(width), np.zeros((width, width)))
        return pd.DataFrame(
            [(parts["series_id"].iloc[0], n, int(parts["missing"].sum()), parts["end"].max(), mean.tolist(), r.ravel().tolist())],
            columns=["series_id", "n", "missing", "end", "mean", "r"],
        )

    return run


def fit_linear_orthogonal(
    train: DataFrame, regressors: Sequence[str], target: str, model: str = LINEAR, fan_in: int = 256
) -> DataFrame:
    """Coefficients per series as rows of the model table (intercept and each regressor), plus ``sse``.

    Rows with a null or non-finite value take no part and make the series' status ``missing_values``; a series with
    fewer rows than coefficients, or none, gets no params and status ``too_short``. Other columns are not read.
    """
    columns = [*regressors, target]
    width = len(columns)
    rows = train.select("series_id", "ds", *[F.col(c).cast("double").alias(c) for c in columns])
    partial = rows.mapInPandas(_partials(columns), PARTIAL)
    slotted = partial.withColumn("slot", F.pmod(F.monotonically_increasing_id(), F.lit(fan_in)))
    first = slotted.groupBy("series_id", "slot").applyInPandas(_merged(width), PARTIAL)
    merged = first.groupBy("series_id").applyInPandas(_merged(width), PARTIAL)

    names = [INTERCEPT, *[c.removeprefix("z_") for c in regressors], "sse"]

    @F.pandas_udf("array<double>")
    def solved(ns: pd.Series, means: pd.Series, rs: pd.Series) -> pd.Series:
        out = []
        for n, mean, r in zip(ns, means, rs):
            if n <= len(regressors):
                out.append(None)
                continue
            coefficients, sse = solve(int(n), np.asarray(mean, float), np.asarray(r, float).reshape(width, width))
            out.append([*coefficients.tolist(), sse])
        return pd.Series(out)

    fitted = merged.withColumn("c", solved("n", "mean", "r"))
    usable = F.col("c").isNotNull() & (F.col("missing") == 0)
    status = F.when(F.col("missing") > 0, "missing_values").when(F.col("c").isNull(), "too_short").otherwise("ok")
    return fitted.select(
        "series_id",
        F.lit(model).alias("model"),
        F.when(usable, F.map_from_arrays(F.array(*map(F.lit, names)), "c")).alias("params"),
        F.lit(None).cast("array<double>").alias("state"),
        status.alias("status"),
        F.col("end").alias("train_end"),
    )
