"""The operators as queries over a folder of tables: orders per month and nation, unless said otherwise.

Dates appear as ``yyyy-MM`` labels and doubles rounded, so that results can be compared by value.
"""

from __future__ import annotations

import math
from functools import reduce
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from monthloom.config import EXOG_COLS, FEATURE_COLS, HOLT_WINTERS, LINEAR, PanelConfig
from monthloom.functions.calendar import date_label
from monthloom.functions.layout import in_order
from monthloom.functions.numeric import whole_count
from monthloom.operators.features import (
    add_features, future_features, seasonal_difference, series_arrays, split_by_time, too_short,
)
from monthloom.operators.history import History, history, history_summary
from monthloom.operators.holtwinters import fit_holtwinters, smooth, smoothed_forecast
from monthloom.operators.linear import coefficient_report, fit_linear, fit_linear_pooled, predict_linear
from monthloom.operators.metrics import as_counts, forecast_summary, leaderboard, score, union_forecasts, unpaired
from monthloom.operators.mlp import Z_COLS, Network, full_gradient, network_expression, predict_network, train_network
from monthloom.operators.rollup import monthly_panel
from monthloom.operators.sarima import error_path, fit_sarima
from monthloom.operators.orthogonal import fit_linear_orthogonal
from monthloom.operators.statespace import Order, fit_statespace, forecast_statespace, likelihood_fixed
from monthloom.operators.scaling import apply_scaler, fit_scaler, standardise, unscale
from monthloom.plans.forecasting import forecast_all
from monthloom.plans.training import evaluate_models, prepare
from monthloom.session import checkpoint_folder, written_by_series
from monthloom.sources.panels import order_panel, read_table, shipment_panel
from monthloom.sources.store import read_metrics, write_metrics

# The years that stand in for an anomaly in these tables, and the filters of the history queries.
CONFIG = PanelConfig(anomaly_years=(1998, 1999))
YEARS = (1996, 2000)
SEASON = "monsoon"
# Given weights for the recursions that are checked by value.
SMOOTHING = (0.4, 0.1, 0.3)
ARMA = (0.437, 0.381, -0.731, -0.863)
# Given weights of an ARMA(1,1) whose exact likelihood, from its stationary start, is checked by value.
KALMAN_ARMA = (0.437, -0.731)
# Orders fitted by likelihood beside the configured one, with or without the regressors.
ORDERS = ((Order(0, 1, 1, 0, 1, 1, 12), False), (Order(1, 1, 0, 1, 1, 0, 12), False), (Order(2, 1, 1, 0, 1, 1, 12), True))
OLS2 = ("lag_1", "lag_12")
NAIVE = "Seasonal Naive"

Query = Callable[[SparkSession, str], DataFrame]


def formula_network(sizes: tuple[int, ...]) -> Network:
    """A network whose weights follow from their position: sin(0.7 i + 1.3 j + layer) * sqrt(2 / n_in)."""
    weights, biases = [], []
    for layer, (a, b) in enumerate(zip(sizes, sizes[1:])):
        i, j = np.arange(a)[:, None], np.arange(b)[None, :]
        weights.append(np.sin(0.7 * i + 1.3 * j + layer) * math.sqrt(2.0 / a))
        biases.append(0.1 * np.cos(np.arange(b) + layer))
    return Network(tuple(weights), tuple(biases))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


def _labelled(df: DataFrame) -> DataFrame:
    return df.select(*[date_label(F.col("ds")).alias("date_label") if c == "ds" else c for c in df.columns])


def _history(spark: SparkSession, folder: str) -> History:
    return history(order_panel(spark, folder), *YEARS, SEASON, CONFIG)


def _features(spark: SparkSession, folder: str) -> DataFrame:
    return add_features(order_panel(spark, folder), CONFIG)


def _split(spark: SparkSession, folder: str) -> DataFrame:
    return split_by_time(_features(spark, folder), CONFIG)


def _train(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).where("split = 'train'")


def _train_by_series(panel: DataFrame) -> DataFrame:
    """Training rows as a table by series, which keeps the fits that follow spread over all tasks."""
    train = split_by_time(add_features(panel, CONFIG), CONFIG).where("split = 'train'")
    return written_by_series(train.select("series_id", "ds", "y", *EXOG_COLS))


def _test(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).where("split = 'test'")


def _scaled(spark: SparkSession, folder: str) -> DataFrame:
    return standardise(_split(spark, folder))


def _naive(test: DataFrame) -> DataFrame:
    step = F.row_number().over(in_order())
    return test.select("series_id", F.lit(NAIVE).alias("model"), "ds", step.alias("step"), F.col("lag_12").alias("yhat"))


def _smoothed(train: DataFrame) -> DataFrame:
    states = smooth(series_arrays(train, "y"), *SMOOTHING)
    rows = smoothed_forecast(states.select("series_id", "smoothed", F.array_max("ds").alias("end")), CONFIG.test_months)
    return rows.select(
        "series_id", F.lit(HOLT_WINTERS).alias("model"), F.add_months("end", F.col("step")).alias("ds"), "step", "yhat"
    )


def _linear2(train: DataFrame, test: DataFrame) -> DataFrame:
    step = F.row_number().over(in_order())
    fitted = predict_linear(test, fit_linear(train, OLS2, "y"), OLS2)
    return fitted.select("series_id", F.lit(LINEAR).alias("model"), "ds", step.alias("step"), "yhat")


def _forecasts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Held-out rows and the forecasts of the three models that have a closed form."""
    split = _split(spark, folder)
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    return test, union_forecasts(_naive(test), _smoothed(train), _linear2(train, test))


def q_monthly_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(order_panel(spark, folder))


def q_segment_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(order_panel(spark, folder, by="c_mktsegment"))


def q_shipment_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(shipment_panel(spark, folder))


def q_short_series(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with too few months for a forecast: one series per customer."""
    panel = monthly_panel(read_table(spark, folder, "orders"), "o_orderdate", ["o_custkey"])
    return too_short(panel, CONFIG)


def q_history_records(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).records


def q_monthly_average(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).monthly_average


def q_season_average(spark: SparkSession, folder: str, by: str = "n_name") -> DataFrame:
    return history(order_panel(spark, folder, by), *YEARS, SEASON, CONFIG).season_average


def q_history_meta(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).meta


def q_history_summary(spark: SparkSession, folder: str) -> DataFrame:
    return history_summary(order_panel(spark, folder), *YEARS, SEASON, CONFIG)


def q_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = _features(spark, folder)
    return rounded(_labelled(rows.select("series_id", "ds", "y", "year", "month", *FEATURE_COLS)))


def q_train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return _labelled(_split(spark, folder).select("series_id", "ds", "split", "y"))


def q_seasonal_difference(spark: SparkSession, folder: str) -> DataFrame:
    rows = seasonal_difference(order_panel(spark, folder)).where("dy IS NOT NULL")
    return _labelled(rows.select("series_id", "ds", "dy"))


def q_feature_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fit_scaler(_train(spark, folder), FEATURE_COLS))


def q_target_scaler(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(fit_scaler(_train(spark, folder), ("y",)))


def q_zscore_transform(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scaled(spark, folder)
    return rounded(_labelled(rows.select("series_id", "ds", "split", *Z_COLS, "z_y")))


def q_zscore_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    split = _split(spark, folder)
    scaler = fit_scaler(split.where("split = 'train'"))
    scaled = apply_scaler(split, scaler, ("lag_12", "y"), keep_target=True)
    rows = scaled.select("series_id", "ds", "z_lag_12", "z_y", unscale(F.col("z_y")).alias("y_back"))
    return rounded(_labelled(rows))


def q_ols_fit2(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_linear(_train(spark, folder), OLS2, "y")
    names = ("intercept", *OLS2)
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n) for n in names]))


def q_ols_coefficients(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(coefficient_report(fit_linear(_train(spark, folder), OLS2, "y"), OLS2))


def q_ols_predict2(spark: SparkSession, folder: str) -> DataFrame:
    split = _split(spark, folder)
    rows = _linear2(split.where("split = 'train'"), split.where("split = 'test'"))
    return rounded(_labelled(rows.select("series_id", "ds", "step", "yhat")))


def q_ols_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Slopes of ten scaled regressors; the intercept of scaled rows is zero but for rounding."""
    fitted = fit_linear(_scaled(spark, folder).where("split = 'train'"), Z_COLS, "z_y")
    return rounded(coefficient_report(fitted, Z_COLS).where("position > 0"))


def q_ols_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Orders against the month's date in seconds (mean about 1e9), by orthogonal reduction; slope per year of 365.25 days."""
    panel = order_panel(spark, folder).withColumn("seconds", F.datediff("ds", F.lit("1970-01-01")).cast("double") * 86400)
    fitted = fit_linear_orthogonal(panel, ["seconds"], "y")
    return fitted.select(
        "series_id", "status", F.round(F.col("params")["intercept"], 2).alias("intercept"),
        F.round(F.col("params")["seconds"] * 31557600, 4).alias("slope_per_year"),
    )


def q_ols_pooled(spark: SparkSession, folder: str) -> DataFrame:
    """One fit over the scaled rows of all nations."""
    regressors = [f"z_{c}" for c in OLS2]
    fitted = fit_linear_pooled(_scaled(spark, folder).where("split = 'train'"), regressors, "z_y")
    return rounded(coefficient_report(fitted, regressors).where("position > 0"))


def q_ols_backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy of the ten-regressor fit on the held-out months."""
    scaled = _scaled(spark, folder)
    test = scaled.where("split = 'test'")
    fitted = predict_linear(test, fit_linear(scaled.where("split = 'train'"), Z_COLS, "z_y"), Z_COLS, out="z_yhat")
    forecasts = fitted.select("series_id", F.lit(LINEAR).alias("model"), "ds", unscale(F.col("z_yhat")).alias("yhat"))
    return score(test, forecasts)


def q_ols_forecast(spark: SparkSession, folder: str) -> DataFrame:
    """Counts for the next twelve months by the ten-regressor fit and the scaler of its training rows."""
    split = _split(spark, folder)
    scaler = fit_scaler(split.where("split = 'train'"))
    params = fit_linear(standardise(split).where("split = 'train'"), Z_COLS, "z_y")
    future = future_features(_features(spark, folder), 12, CONFIG)
    fitted = predict_linear(apply_scaler(future, scaler, keep_target=True), params, Z_COLS, out="z_yhat")
    counts = fitted.withColumn("yhat", whole_count(unscale(F.col("z_yhat"))))
    return _labelled(counts.select("series_id", "step", "ds", "yhat"))


def q_future_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = future_features(_features(spark, folder), 12, CONFIG)
    return rounded(_labelled(rows.select("series_id", "step", "ds", "year", "month", *FEATURE_COLS)))


def q_forecast_post(spark: SparkSession, folder: str) -> DataFrame:
    """Half the change against last year as a count: has negative values and exact halves."""
    half = (F.col("y") - F.col("lag_12")) / 2
    return _labelled(_features(spark, folder).select("series_id", "ds", whole_count(half).alias("count")))


def q_hw_forecast_fixed(spark: SparkSession, folder: str) -> DataFrame:
    rows = _smoothed(_train(spark, folder))
    return rounded(_labelled(rows.select("series_id", "ds", "step", "yhat")))


def q_hw_state_fixed(spark: SparkSession, folder: str) -> DataFrame:
    states = smooth(series_arrays(order_panel(spark, folder), "y"), *SMOOTHING)
    return rounded(states.select("series_id", "smoothed.level", "smoothed.trend", "smoothed.sse"))


def q_hw_fit(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_holtwinters(series_arrays(_train_by_series(order_panel(spark, folder)), "y"), CONFIG)
    names = ("alpha", "beta", "gamma", "sse")
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n) for n in names]), 4)


def q_hw_fit_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities shipped, one series per supplier."""
    fitted = fit_holtwinters(series_arrays(_train_by_series(shipment_panel(spark, folder)), "y"), CONFIG)
    names = ("alpha", "beta", "gamma", "sse")
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n) for n in names]), 4)


def q_sarma_filter_fixed(spark: SparkSession, folder: str) -> DataFrame:
    differenced = seasonal_difference(order_panel(spark, folder)).where("dy IS NOT NULL")
    path = error_path(series_arrays(differenced, "dy"), *ARMA, values="dy")
    rows = path.select("series_id", F.explode(F.arrays_zip("ds", "errors")).alias("row"))
    return rounded(_labelled(rows.select("series_id", F.col("row.ds").alias("ds"), F.col("row.errors").alias("error"))))


def q_sarima_fit(spark: SparkSession, folder: str) -> DataFrame:
    fitted = fit_sarima(series_arrays(_train_by_series(order_panel(spark, folder)), "y", *EXOG_COLS), cfg=CONFIG)
    names = ("ar", "seasonal_ar", "ma", "seasonal_ma", "sse", "is_covid")
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n) for n in names]), 4)


def q_sarima_fit_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities shipped, one series per supplier."""
    arrays = series_arrays(_train_by_series(shipment_panel(spark, folder)), "y", *EXOG_COLS)
    fitted = fit_sarima(arrays, cfg=CONFIG)
    names = ("ar", "seasonal_ar", "ma", "seasonal_ma", "sse")
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n) for n in names]), 4)


def q_arma_likelihood_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Exact log likelihood of each differenced series under given ARMA(1,1) weights, by the Kalman filter."""
    differenced = seasonal_difference(order_panel(spark, folder)).where("dy IS NOT NULL")
    kept = likelihood_fixed(series_arrays(differenced, "dy"), KALMAN_ARMA, Order(1, 0, 1, 0, 0, 0, 12), "dy", "stationary")
    n = F.size("dy")
    squares = F.aggregate(F.zip_with("innovations", "variances", lambda v, f: v * v / f), F.lit(0.0), lambda a, b: a + b)
    logs = F.aggregate(F.transform("variances", lambda f: F.log(f)), F.lit(0.0), lambda a, b: a + b)
    sigma2 = squares / n
    loglike = -0.5 * (n * F.log(2 * math.pi * sigma2) + logs + n)
    return rounded(kept.select("series_id", n.cast("long").alias("n"), F.log(sigma2).alias("log_sigma2"), loglike.alias("loglike")), 6)


def _likelihood_fit(spark: SparkSession, folder: str, order: Order, exog: tuple[str, ...]) -> DataFrame:
    arrays = series_arrays(_train_by_series(order_panel(spark, folder)), "y", *exog)
    return fit_statespace(arrays, order, exog)


def q_sarima_mle(spark: SparkSession, folder: str) -> DataFrame:
    """The configured SARIMA with the four flags, fitted by exact likelihood."""
    fitted = _likelihood_fit(spark, folder, Order(), EXOG_COLS)
    names = (*Order().names, "loglike", "aic", *EXOG_COLS)
    return rounded(fitted.select("series_id", "status", *[F.col("params")[n].alias(n.replace(".", "_")) for n in names]), 4)


def q_sarima_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Three more orders by exact likelihood, two of them without regressors."""
    parts = [_likelihood_fit(spark, folder, order, EXOG_COLS if exog else ()) for order, exog in ORDERS]
    rows = [p.select("series_id", "order", "status", F.col("params")["loglike"].alias("loglike"), F.col("params")["aic"].alias("aic")) for p in parts]
    return rounded(reduce(DataFrame.unionByName, rows), 4)


def q_sarima_mle_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Errors over the held-out months of the likelihood fit's forecasts, per series."""
    fitted = _likelihood_fit(spark, folder, Order(), EXOG_COLS)
    test = _test(spark, folder)
    ahead = forecast_statespace(fitted, CONFIG.test_months, test, Order(), EXOG_COLS)
    return score(test, ahead)


def q_mlp_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Network output by Spark expressions."""
    network = formula_network((len(Z_COLS), 64, 32, 1))
    inputs = F.array(*Z_COLS).cast("array<double>")
    rows = _scaled(spark, folder).withColumn("yhat", network_expression(network, inputs))
    return rounded(_labelled(rows.select("series_id", "ds", "yhat")))


def q_mlp_forward_batched(spark: SparkSession, folder: str) -> DataFrame:
    """The same output by Arrow batches, as used for large panels."""
    network = formula_network((len(Z_COLS), 64, 32, 1))
    rows = predict_network(_scaled(spark, folder), network, out="yhat")
    return rounded(_labelled(rows.select("series_id", "ds", "yhat")))


def q_mlp_loss(spark: SparkSession, folder: str) -> DataFrame:
    network = formula_network((len(Z_COLS), 64, 32, 1))
    rows = predict_network(_scaled(spark, folder), network, out="yhat")
    miss = F.col("yhat") - F.col("z_y")
    return rounded(rows.groupBy("series_id", "split").agg(F.avg(miss * miss).alias("mse")))


def q_mlp_gradient(spark: SparkSession, folder: str) -> DataFrame:
    network = formula_network((len(Z_COLS), 4, 1))
    return rounded(full_gradient(_scaled(spark, folder).where("split = 'train'"), network))


def q_mlp_train(spark: SparkSession, folder: str) -> DataFrame:
    trained = train_network(written_by_series(prepare(order_panel(spark, folder), CONFIG)), CONFIG)
    return rounded(trained.history, 4)


def q_forecast_union(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_labelled(_forecasts(spark, folder)[1]))


def q_forecast_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return score(*_forecasts(spark, folder))


def q_metrics_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the three models, written to the shared folder as JSON and read back."""
    path = f"{checkpoint_folder(spark)}/metrics-{uuid.uuid4().hex}"
    write_metrics(score(*_forecasts(spark, folder)), path)
    return read_metrics(spark, path)


def q_unpaired_months(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out months against forecasts that are dated three months late."""
    test = _test(spark, folder)
    late = _naive(test).withColumn("ds", F.add_months("ds", 3))
    return _labelled(unpaired(test, late))


def q_seasonal_naive_metrics(spark: SparkSession, folder: str) -> DataFrame:
    test = _test(spark, folder)
    return score(test, _naive(test))


def q_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    return leaderboard(score(*_forecasts(spark, folder)))


def q_forecast_summary(spark: SparkSession, folder: str) -> DataFrame:
    return forecast_summary(as_counts(_forecasts(spark, folder)[1]))


def q_backtest_all(spark: SparkSession, folder: str) -> DataFrame:
    return evaluate_models(order_panel(spark, folder), CONFIG).metrics


def q_forecast_all(spark: SparkSession, folder: str) -> DataFrame:
    panel = written_by_series(order_panel(spark, folder))
    return _labelled(forecast_all(panel, evaluate_models(panel, CONFIG).models, 12, CONFIG))


QUERIES: dict[str, Query] = {
    name.removeprefix("q_"): query for name, query in list(globals().items()) if name.startswith("q_")
}
