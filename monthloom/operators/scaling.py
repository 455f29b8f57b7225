"""Z-scores by the statistics of the training rows, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.config import FEATURE_COLS

TARGET = "y"


def fit_scaler(train: DataFrame, columns: Sequence[str] = (*FEATURE_COLS, TARGET)) -> DataFrame:
    """Mean and population deviation of each column as rows ``(series_id, column, mean, std)``."""
    moments = [
        F.struct(F.lit(c).alias("column"), F.avg(c).alias("mean"), _spread(F.stddev_pop(c)).alias("std"))
        for c in columns
    ]
    return train.groupBy("series_id").agg(F.array(*moments).alias("moments")).selectExpr("series_id", "inline(moments)")


def apply_scaler(
    rows: DataFrame, scaler: DataFrame, columns: Sequence[str] = FEATURE_COLS, keep_target: bool = False
) -> DataFrame:
    """Add ``z_<column>`` by a fitted scaler; with ``keep_target`` also the target's ``y_mean`` and ``y_std``."""
    joined = rows.join(_one_row_per_series(scaler), "series_id")
    m = F.col("moments")
    added = {f"z_{c}": (F.col(c) - m[c]["mean"]) / m[c]["std"] for c in columns}
    if keep_target:
        added |= {"y_mean": m[TARGET]["mean"], "y_std": m[TARGET]["std"]}
    return joined.withColumns(added).drop("moments")


def standardise(split: DataFrame, columns: Sequence[str] = (*FEATURE_COLS, TARGET)) -> DataFrame:
    """``z_<column>`` for train and test rows, with ``y_mean`` and ``y_std``.

    The same numbers as :func:`fit_scaler` on the training rows and :func:`apply_scaler`, in one pass over rows
    that already lie together by series.
    """
    over = "OVER (PARTITION BY series_id)"
    train = {c: f"CASE WHEN split = 'train' THEN `{c}` END" for c in columns}
    known = split.selectExpr(
        "*",
        *[f"avg({train[c]}) {over} AS `_mean_{c}`" for c in columns],
        *[f"stddev_pop({train[c]}) {over} AS `_spread_{c}`" for c in columns],
    )
    # A constant column has deviation 0; it is divided by 1 instead.
    std = {c: f"CASE WHEN `_spread_{c}` = 0 THEN 1.0D ELSE `_spread_{c}` END" for c in columns}
    target = [f"`_mean_{TARGET}` AS y_mean", f"{std[TARGET]} AS y_std"] if TARGET in columns else []
    scaled = [f"(`{c}` - `_mean_{c}`) / {std[c]} AS `z_{c}`" for c in columns]
    return known.selectExpr(*[f"`{c}`" for c in split.columns], *scaled, *target)


def unscale(value: Column) -> Column:
    """A scaled target back in its own units."""
    return value * F.col("y_std") + F.col("y_mean")


def _spread(std: Column) -> Column:
    """A constant column has deviation 0; it is divided by 1 instead."""
    return F.when(std == 0, F.lit(1.0)).otherwise(std)


def _one_row_per_series(scaler: DataFrame) -> DataFrame:
    entries = F.collect_list(F.struct("column", F.struct("mean", "std").alias("moment")))
    return scaler.groupBy("series_id").agg(F.map_from_entries(entries).alias("moments"))
