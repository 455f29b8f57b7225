"""Forecast the months after the end of a panel with models that were fitted before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.config import FEATURE_COLS, LINEAR, MLP, PanelConfig
from monthloom.functions.calendar import months_between
from monthloom.operators.features import add_features, future_features
from monthloom.operators.history import checked_horizon
from monthloom.operators.holtwinters import predict_holtwinters
from monthloom.operators.linear import predict_linear
from monthloom.operators.metrics import as_counts, union_forecasts
from monthloom.operators.mlp import Z_COLS, predict_network
from monthloom.operators.sarima import predict_sarima
from monthloom.operators.scaling import apply_scaler, unscale
from monthloom.plans.training import FittedModels
from monthloom.session import written_by_series


def forecast_all(
    panel: DataFrame, models: FittedModels, horizon: object, cfg: PanelConfig = PanelConfig()
) -> DataFrame:
    """Counts per series, model and future month: ``(series_id, model, step, ds, yhat)``.

    The smoothing and ARIMA models go on from the end of their training rows, through the months held out, to the
    months asked for, so that a label is always the month the value is for. A model without a usable fit gives no
    rows for that series (see :func:`forecast_status`); it is an error if nothing at all is usable.
    """
    steps = checked_horizon(horizon)
    if models.network is None and models.params.where("status = 'ok'").isEmpty():
        raise RuntimeError("No fitted model can forecast; fit the models first.")
    future = future_features(add_features(panel, cfg), steps, cfg)
    # Three models read these few rows per series, so they are worked out once.
    scaled = written_by_series(apply_scaler(future, models.scaler, FEATURE_COLS, keep_target=True))
    ends = panel.groupBy("series_id").agg(F.max("ds").alias("last_ds"))
    fitted = models.params.join(ends, "series_id")
    gap = months_between(F.col("last_ds"), F.col("train_end"))
    ahead = fitted.withColumn("gap", gap).where(gap >= 0)
    linear = predict_linear(scaled, models.params.where(F.col("model") == LINEAR), Z_COLS, out="z_yhat")
    parts = [
        _from_scaled(linear, LINEAR),
        predict_sarima(ahead, steps, scaled, skip="gap"),
        predict_holtwinters(ahead, steps, skip="gap"),
    ]
    if models.network is not None:
        parts.insert(0, _from_scaled(predict_network(scaled, models.network), MLP))
    # A value that could not be computed, for want of a month it depends on, is no forecast of zero.
    counts = as_counts(union_forecasts(*parts)).where("yhat is not null")
    return counts.select("series_id", "model", "step", "ds", "yhat")


def forecast_status(models: FittedModels) -> DataFrame:
    """Why a model does or does not forecast a series: ``(series_id, model, status)``."""
    own = models.params.select("series_id", "model", "status")
    if models.network is None:
        return own
    shared = models.scaler.select("series_id").distinct()
    return own.unionByName(shared.select("series_id", F.lit(MLP).alias("model"), F.lit("ok").alias("status")))


def _from_scaled(rows: DataFrame, model: str) -> DataFrame:
    return rows.select("series_id", F.lit(model).alias("model"), "ds", unscale(F.col("z_yhat")).alias("yhat"), "step")
