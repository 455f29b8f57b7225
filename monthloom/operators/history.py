"""The history query: filtered months of each series with averages by month and by season."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.config import HORIZONS, PanelConfig
from monthloom.functions.calendar import date_label, month_name, season_label
from monthloom.functions.numeric import display_whole, two_decimals

ALL_SEASONS = "all"
TOP_SEASONS = 4


@dataclass(frozen=True)
class History:
    """Lazy parts of one answer, each keyed by ``series_id``."""

    meta: DataFrame
    records: DataFrame
    monthly_average: DataFrame
    season_average: DataFrame

    def payload(self) -> DataFrame:
        """One JSON document per series, built from the four parts."""

        def rows(part: DataFrame, name: str, *order: str) -> DataFrame:
            fields = [c for c in part.columns if c != "series_id"]
            # The sort key goes in front and comes off again after the sort.
            item = F.struct(*order, F.struct(*fields).alias("row"))
            listed = F.transform(F.array_sort(F.collect_list(item)), lambda r: r["row"])
            return part.groupBy("series_id").agg(listed.alias(name))

        ranked = self.season_average.withColumn("order", -F.col("average_arrivals"))
        season_rows = rows(ranked, "season_average", "order", "season").withColumn(
            "season_average", F.transform("season_average", lambda r: r.dropFields("order"))
        )
        document = (
            self.meta.select("series_id", F.struct(*[c for c in self.meta.columns if c != "series_id"]).alias("meta"))
            .join(rows(self.records, "records", "date"), "series_id", "left")
            .join(rows(self.monthly_average, "monthly_average", "month"), "series_id", "left")
            .join(season_rows, "series_id", "left")
        )
        parts = ("records", "monthly_average", "season_average")
        filled = document.withColumns({p: F.coalesce(p, F.array().cast(document.schema[p].dataType)) for p in parts})
        return filled.select("series_id", F.to_json(F.struct("meta", *parts)).alias("payload"))


def whole_number(value: object, name: str) -> int:
    """An integer, or a string that spells one; anything else is refused."""
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ValueError(f"{name} must be an integer.")
    try:
        return int(value)
    except ValueError:
        raise ValueError(f"{name} must be an integer.") from None


def checked_filters(
    start_year: object, end_year: object, season: str, cfg: PanelConfig
) -> tuple[int | None, int | None, str]:
    start = None if start_year is None else whole_number(start_year, "start_year")
    end = None if end_year is None else whole_number(end_year, "end_year")
    if start is not None and end is not None and start > end:
        raise ValueError("The first year asked for comes after the last one.")
    allowed = {ALL_SEASONS, *cfg.seasons}
    if season not in allowed:
        raise ValueError(f"There is no season {season!r}; known are {sorted(allowed)}.")
    return start, end, season


def checked_horizon(horizon: object) -> int:
    steps = whole_number(horizon, "horizon")
    if steps not in HORIZONS:
        raise ValueError(f"horizon must be one of {list(HORIZONS)}.")
    return steps


def history(
    panel: DataFrame,
    start_year: object = None,
    end_year: object = None,
    season: str = ALL_SEASONS,
    cfg: PanelConfig = PanelConfig(),
    ordered: bool = True,
) -> History:
    """Answer the query for every series. A missing bound is the first or last year of the series.

    ``monthly_average`` follows both filters; ``season_average`` follows the years only. ``ordered=False`` leaves
    rows as they lie, which spares a sort of the whole answer when it goes into a table.
    """
    start, end, season = checked_filters(start_year, end_year, season, cfg)
    labelled = with_season(panel, cfg)
    in_years = _in_years(start, end)
    selected = in_years & _in_season(season)
    of_years = labelled.where(in_years)
    rows = of_years.where(_in_season(season))
    meta = labelled.groupBy("series_id").agg(
        F.coalesce(F.lit(start), F.min("year")).alias("start_year"),
        F.coalesce(F.lit(end), F.max("year")).alias("end_year"),
        F.lit(season).alias("season"),
        # Counting whole rows reads the same columns as the records do, and so the same shuffled totals.
        F.count(F.when(selected, F.struct("ds", "y"))).alias("records"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
    )
    records = rows.select(
        "series_id",
        date_label(F.col("ds")).alias("date"),
        "year",
        "month",
        month_name(F.col("ds")).alias("month_name"),
        "season",
        F.col("y").cast("bigint").alias("arrivals"),
    )
    monthly = rows.groupBy("series_id", "month", month_name(F.col("ds")).alias("month_name")).agg(
        two_decimals(F.avg("y")).alias("average_arrivals")
    )
    seasonal = of_years.groupBy("series_id", "season").agg(two_decimals(F.avg("y")).alias("average_arrivals"))
    if ordered:
        records = records.orderBy("series_id", "date")
        monthly = monthly.orderBy("series_id", "month")
        seasonal = seasonal.orderBy("series_id", F.desc("average_arrivals"), "season")
    return History(meta, records, monthly, seasonal)


def history_summary(
    panel: DataFrame,
    start_year: object = None,
    end_year: object = None,
    season: str = ALL_SEASONS,
    cfg: PanelConfig = PanelConfig(),
) -> DataFrame:
    """Per series: average and latest of the selected months, and its seasons with the highest averages.

    One row per series and top season. A series without a selected month has average 0 and no latest month.
    """
    start, end, season = checked_filters(start_year, end_year, season, cfg)
    labelled = with_season(panel, cfg)
    in_years = _in_years(start, end)
    selected = in_years & _in_season(season)
    by_season = labelled.groupBy("series_id", "season").agg(
        F.sum(F.when(selected, F.coalesce("y", F.lit(0)))).alias("selected_sum"),
        F.count_if(selected).alias("selected_rows"),
        F.max(F.when(selected, F.struct("ds", "y"))).alias("latest"),
        F.avg(F.when(in_years, F.col("y"))).alias("average"),
    )
    ranked = F.filter(
        F.array_sort(F.collect_list(F.struct((-F.col("average")).alias("order"), "season", "average"))),
        lambda r: r["average"].isNotNull(),
    )
    per_series = by_season.groupBy("series_id").agg(
        F.when(F.sum("selected_rows") > 0, F.sum("selected_sum") / F.sum("selected_rows"))
        .otherwise(F.lit(0.0))
        .alias("average"),
        F.max("latest").alias("latest"),
        F.slice(ranked, 1, TOP_SEASONS).alias("top"),
    )
    return per_series.select(
        "series_id",
        display_whole(F.col("average")).alias("average_selected"),
        date_label(F.col("latest.ds")).alias("latest_month"),
        F.col("latest.y").cast("bigint").alias("latest_value"),
        F.posexplode_outer("top").alias("pos", "row"),
    ).select(
        "series_id",
        "average_selected",
        "latest_month",
        "latest_value",
        (F.col("pos") + 1).alias("season_rank"),
        F.col("row.season").alias("season"),
        display_whole(F.col("row.average")).alias("season_average"),
    )


def with_season(panel: DataFrame, cfg: PanelConfig) -> DataFrame:
    return panel.withColumn("season", season_label(F.col("month"), cfg))


def _in_years(start: int | None, end: int | None) -> Column:
    after = F.lit(True) if start is None else F.col("year") >= start
    before = F.lit(True) if end is None else F.col("year") <= end
    return after & before


def _in_season(season: str) -> Column:
    return F.lit(True) if season == ALL_SEASONS else F.col("season") == season
