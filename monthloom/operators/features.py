"""Features of each month, the split by time, and differencing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthloom.config import LAGS, PERIOD, PanelConfig
from monthloom.functions.calendar import flag, month_cos, month_sin
from monthloom.functions.layout import by_series, in_order

def calendar_features(rows: DataFrame, cfg: PanelConfig, anomaly: bool = True) -> DataFrame:
    """Cyclic month, season flags and the anomaly flag; ``anomaly=False`` sets that flag to 0."""
    month, seasons = F.col("month"), cfg.season_months
    return rows.withColumns(
        {
            "month_sin": month_sin(month),
            "month_cos": month_cos(month),
            "is_spring_trek": flag(month, seasons["spring_trek"]),
            "is_autumn_trek": flag(month, seasons["autumn_trek"]),
            "is_monsoon": flag(month, seasons["monsoon"]),
            "is_covid": flag(F.col("year"), cfg.anomaly_years) if anomaly else F.lit(0),
        }
    )


def add_features(panel: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """The panel with its model features; months without a full set of lags are dropped.

    Year bounds are those of the whole series, before that drop.
    """
    whole, ordered = by_series(), in_order()
    first, last = F.min("year").over(whole), F.max("year").over(whole)
    lagged = panel.withColumns({f"lag_{k}": F.lag("y", k).over(ordered).cast("double") for k in LAGS})
    scaled_year = lagged.withColumn("year_norm", (F.col("year") - first) / F.greatest(last - first, F.lit(1)))
    return calendar_features(scaled_year, cfg).dropna(subset=[f"lag_{k}" for k in LAGS])


def split_by_time(rows: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Mark each series' last ``test_months`` rows ``test`` and the rest ``train``.

    Series that would have no training row are left out; :func:`too_short` lists them.
    """
    counted = rows.withColumns(
        {"position": F.row_number().over(in_order()), "n_rows": F.count(F.lit(1)).over(by_series())}
    ).where(F.col("n_rows") > cfg.test_months)
    is_train = F.col("position") <= F.col("n_rows") - cfg.test_months
    return counted.withColumn("split", F.when(is_train, "train").otherwise("test")).drop("position", "n_rows")


def too_short(panel: DataFrame, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Series with too few months for lags and a test window, with their number of months."""
    least = max(LAGS) + cfg.test_months
    return panel.groupBy("series_id").agg(F.count(F.lit(1)).alias("n_months")).where(F.col("n_months") <= least)


def seasonal_difference(panel: DataFrame) -> DataFrame:
    """``y`` after one regular and one seasonal difference; NULL where a term is missing."""
    y, lag = F.col("y"), lambda k: F.lag("y", k).over(in_order())
    return panel.withColumn("dy", (y - lag(1) - lag(PERIOD) + lag(PERIOD + 1)).cast("double"))


def series_arrays(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per series: its months in order, each column as an array. A series is a few hundred months."""
    ordered = rows.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("ds", *columns))).alias("rows"))
    return ordered.select("series_id", *[F.col(f"rows.{c}").alias(c) for c in ("ds", *columns)])


def future_features(panel_or_features: DataFrame, steps: int, cfg: PanelConfig = PanelConfig()) -> DataFrame:
    """Features of the ``steps`` months after the end of each series.

    Lags repeat the last observed value once they would reach past the end; forecasts are not fed back. A lag
    from before the first row is 0. The anomaly flag is 0.
    """
    per_series = panel_or_features.groupBy("series_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ds", "y"))), lambda r: r["y"].cast("double")).alias("ys"),
        F.max("ds").alias("last_ds"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
    )
    n, step = F.size("ys"), F.col("step")

    def lag(k: int):
        at = n + step - k
        return F.when(at < 1, F.lit(0.0)).otherwise(F.get("ys", F.least(at, n) - 1))

    months = per_series.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    dated = months.withColumn("ds", F.add_months("last_ds", step)).withColumns(
        {"year": F.year("ds"), "month": F.month("ds")}
    )
    span = F.greatest(F.greatest("year_max", "year") - F.col("year_min"), F.lit(1))
    known = dated.withColumns(
        {"year_norm": (F.col("year") - F.col("year_min")) / span, **{f"lag_{k}": lag(k) for k in LAGS}}
    )
    return calendar_features(known, cfg, anomaly=False).drop("ys", "last_ds", "year_min", "year_max")
