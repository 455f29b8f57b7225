"""Fit the four models on a panel, score them on the held-out months, and keep what was fitted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.config import EXOG_COLS, LAGS, LEAD_ORDER, LINEAR, MLP, PanelConfig
from monthloom.functions.layout import in_order
from monthloom.operators.features import add_features, series_arrays, split_by_time
from monthloom.operators.holtwinters import fit_holtwinters, predict_holtwinters
from monthloom.operators.linear import fit_linear, predict_linear
from monthloom.operators.metrics import score, union_forecasts
from monthloom.operators.mlp import Z_COLS, Network, Training, predict_network, train_network
from monthloom.operators.sarima import fit_sarima, predict_sarima
from monthloom.operators.scaling import fit_scaler, standardise, unscale
from monthloom.session import written_by_series


@dataclass(frozen=True)
class FittedModels:
    """What forecasting needs: a scaler and a model table keyed by series, and one shared network."""

    scaler: DataFrame
    params: DataFrame
    network: Network | None


@dataclass(frozen=True)
class Evaluation:
    models: FittedModels
    forecasts: DataFrame
    metrics: DataFrame
    training: Training


def prepare(panel: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Features, split and z-scores of every usable row."""
    return standardise(split_by_time(add_features(panel, cfg), cfg))


def fit_per_series(prepared: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The model table of the three per-series models: one row per series and model, with a status.

    Pass rows written by series. Fitting costs much time per byte, and adaptive planning, which sizes tasks by bytes,
    would put all of it into a few; it leaves the buckets of a table alone.
    """
    train = prepared.where("split = 'train'")
    arrays = series_arrays(train, "y", *EXOG_COLS)
    linear = fit_linear(train, Z_COLS, "z_y")
    return linear.unionByName(fit_holtwinters(arrays, cfg)).unionByName(fit_sarima(arrays, cfg=cfg))


def backtest_forecasts(prepared: DataFrame, params: DataFrame, network: Network | None, cfg: PanelConfig) -> DataFrame:
    """Each model's forecasts of the held-out months as one long table."""
    test = prepared.where("split = 'test'")
    linear = predict_linear(test, params.where(F.col("model") == LINEAR), Z_COLS, out="z_yhat")
    parts = [
        _from_scaled(linear, LINEAR),
        predict_sarima(params, cfg.test_months, test),
        predict_holtwinters(params, cfg.test_months),
    ]
    if network is not None:
        parts.insert(0, _from_scaled(predict_network(test, network), MLP))
    return union_forecasts(*parts)


def evaluate_models(panel: DataFrame, cfg: PanelConfig = PanelConfig()) -> Evaluation:
    """Prepare, fit all four models, and score them on the same held-out months.

    The model table also says why a series of ``panel`` has no fit; a model that fails leaves the others as they are.
    """
    prepared = written_by_series(prepare(panel, cfg))
    training = train_network(prepared, cfg)
    statuses = _left_out(panel, prepared, cfg)
    if training.network is None:
        failed = prepared.select("series_id", F.lit(MLP).alias("model"), F.lit("not_converged").alias("status"))
        statuses = statuses.union(failed.distinct())
    params = written_by_series(fit_per_series(prepared, cfg).unionByName(statuses, allowMissingColumns=True))
    scaler = fit_scaler(prepared.where("split = 'train'"))
    forecasts = backtest_forecasts(prepared, params, training.network, cfg)
    metrics = score(prepared.where("split = 'test'"), forecasts)
    return Evaluation(FittedModels(scaler, params, training.network), forecasts, metrics, training)


def _left_out(panel: DataFrame, prepared: DataFrame, cfg: PanelConfig) -> DataFrame:
    """``(series_id, model, status)`` for all models of the series that no usable row is left of."""
    counted = panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_months"))
    absent = counted.join(prepared.select("series_id").distinct(), "series_id", "left_anti")
    short = F.col("n_months") <= max(LAGS) + cfg.test_months
    status = F.when(short, "too_short").otherwise("missing_values")
    models = F.explode(F.array(*map(F.lit, LEAD_ORDER)))
    return absent.select("series_id", models.alias("model"), status.alias("status"))


def _from_scaled(rows: DataFrame, model: str) -> DataFrame:
    step = F.row_number().over(in_order())
    yhat = unscale(F.col("z_yhat"))
    return rows.select("series_id", F.lit(model).alias("model"), "ds", step.alias("step"), yhat.alias("yhat"))
