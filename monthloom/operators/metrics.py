"""Accuracy of forecasts, the ranking of models, and the summary of a horizon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from monthloom.config import LEAD_ORDER
from monthloom.functions.calendar import date_label
from monthloom.functions.numeric import display_whole, two_decimals, whole_count

FORECAST_COLS = ("series_id", "model", "ds", "step", "yhat")


def union_forecasts(*parts: DataFrame) -> DataFrame:
    """Forecasts of several models as one long table."""
    return reduce(DataFrame.unionByName, [p.select(*FORECAST_COLS) for p in parts])


def score(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """MAE, RMSE and MAPE in percent per series and model, over months that have both values.

    Zero actuals count for MAE and RMSE but not for MAPE, which is NULL when no other is left.
    """
    pairs = forecasts.join(actuals.select("series_id", "ds", "y"), ["series_id", "ds"])
    error = F.col("y") - F.col("yhat")
    relative = F.when(F.col("y") != 0, F.abs(error / F.col("y")))
    return pairs.groupBy("series_id", "model").agg(
        two_decimals(F.avg(F.abs(error))).alias("mae"),
        two_decimals(F.sqrt(F.avg(error * error))).alias("rmse"),
        two_decimals(F.avg(relative) * 100).alias("mape"),
    )


def unpaired(actuals: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Months that :func:`score` leaves out: a forecast without an actual value, or the reverse."""
    keys = ["series_id", "ds"]
    alone = forecasts.join(actuals, keys, "left_anti").select(*keys, "model", F.lit("forecast").alias("has_only"))
    missed = actuals.join(forecasts, keys, "left_anti")
    return alone.unionByName(
        missed.select(*keys, F.lit(None).cast("string").alias("model"), F.lit("actual").alias("has_only"))
    )


def leaderboard(metrics: DataFrame) -> DataFrame:
    """Each series' models with the one of lowest MAPE marked ``Best`` and the others ``Baseline``."""
    ranking = Window.partitionBy("series_id").orderBy(F.col("mape").asc_nulls_last(), "model")
    return metrics.select(
        "series_id",
        "model",
        display_whole(F.col("mae")).alias("mae"),
        display_whole(F.col("rmse")).alias("rmse"),
        "mape",
        F.when(F.row_number().over(ranking) == 1, "Best").otherwise("Baseline").alias("status"),
    )


def as_counts(forecasts: DataFrame) -> DataFrame:
    """Forecasts as whole, non-negative counts."""
    return forecasts.withColumn("yhat", whole_count(F.col("yhat")))


def forecast_summary(counts: DataFrame, lead_order: tuple[str, ...] = LEAD_ORDER) -> DataFrame:
    """Next value and total of the horizon by each series' lead model: the first of ``lead_order`` it has."""
    per_model = counts.groupBy("series_id", "model").agg(
        F.min_by("yhat", "step").alias("next_value"), F.sum("yhat").alias("total_forecast")
    )
    place = _place(F.col("model"), lead_order)
    lead = F.min_by(F.struct("model", "next_value", "total_forecast"), F.struct(place, "model"))
    return per_model.groupBy("series_id").agg(lead.alias("lead")).select("series_id", "lead.*")


def forecast_payload(counts: DataFrame) -> DataFrame:
    """One map per series: model → ``{months, arrivals}`` as parallel arrays."""
    ordered = F.array_sort(F.collect_list(F.struct("step", date_label(F.col("ds")).alias("month"), "yhat")))
    per_model = counts.groupBy("series_id", "model").agg(ordered.alias("rows"))
    shape = F.struct(F.col("rows.month").alias("months"), F.col("rows.yhat").alias("arrivals"))
    return per_model.groupBy("series_id").agg(
        F.map_from_entries(F.collect_list(F.struct("model", shape))).alias("predictions")
    )


def _place(model: Column, order: tuple[str, ...]) -> Column:
    place = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        place = F.when(model == name, F.lit(i)).otherwise(place)
    return place
