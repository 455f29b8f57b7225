"""Roll event rows up to a dense monthly panel ``(series_id, ds, y, year, month)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthloom.functions.calendar import month_start
from monthloom.functions.layout import in_order
from monthloom.session import fits_broadcast


@dataclass(frozen=True)
class Lookup:
    """A table that gives events further columns: ``left_key`` of what is joined so far = ``key`` of ``table``."""

    table: DataFrame
    left_key: str
    key: str


def monthly_panel(
    events: DataFrame,
    ts_col: str,
    key_cols: Sequence[str],
    value_col: str | None = None,
    lookups: Sequence[Lookup] = (),
    cut_partial: bool = True,
) -> DataFrame:
    """Count events, or sum ``value_col``, per key and month; fill empty months of each series with 0.

    ``key_cols`` may name columns of ``events`` or of a lookup. ``cut_partial`` drops the newest month of the
    whole data unless an event was seen on its last day.
    """
    monthly = _monthly_totals(events, ts_col, key_cols, value_col, lookups)
    if cut_partial:
        monthly = _without_partial_month(monthly)
    return dense_months(monthly.select(_series_id(key_cols).alias("series_id"), "ds", "y"))


def with_calendar(panel: DataFrame) -> DataFrame:
    return panel.withColumns({"year": F.year("ds"), "month": F.month("ds")})


def dense_months(monthly: DataFrame) -> DataFrame:
    """Fill the months missing between a series' first and last with 0.

    Each row stands for itself and for the empty months up to the next row of its series, so the filling needs
    one pass over rows laid out by series and no join with a list of months.
    """
    next_ds = F.lead("ds").over(in_order())
    until = F.coalesce(F.add_months(next_ds, -1), F.col("ds"))
    spans = monthly.select("series_id", F.col("ds").alias("seen"), "y", until.alias("until"))
    one_month = F.expr("INTERVAL 1 MONTH")
    filled = spans.select("series_id", "seen", "y", F.explode(F.sequence("seen", "until", one_month)).alias("ds"))
    zero = F.lit(0).cast(monthly.schema["y"].dataType)
    return with_calendar(
        filled.select("series_id", "ds", F.when(F.col("ds") == F.col("seen"), F.coalesce("y", zero)).otherwise(zero).alias("y"))
    )


def _monthly_totals(
    events: DataFrame, ts_col: str, key_cols: Sequence[str], value_col: str | None, lookups: Sequence[Lookup]
) -> DataFrame:
    """One row per key and month: total ``y`` and the newest day seen."""
    carried = [lk.left_key for lk in lookups if lk.left_key in events.columns]
    own_keys = [k for k in key_cols if k in events.columns]
    own = list(dict.fromkeys([*carried, *own_keys]))
    ts = F.col(ts_col)
    rows = events.where(ts.isNotNull()).select(
        *own,
        month_start(ts).alias("ds"),
        ts.cast("date").alias("last_seen"),
        (F.col(value_col) if value_col else F.lit(1).cast("bigint")).alias("y"),
    )
    if not all(fits_broadcast(lk.table) for lk in lookups):
        # A lookup too large to broadcast means that the events are shuffled by its key. Totals per key and month
        # first: a key that holds a large share of all events then arrives as one row per month.
        rows = _totals(rows, own)
    for lk in lookups:
        rows = rows.join(lk.table, F.col(lk.left_key) == lk.table[lk.key])
    return _totals(rows, key_cols)


def _totals(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys, "ds").agg(F.sum("y").alias("y"), F.max("last_seen").alias("last_seen"))


def _without_partial_month(monthly: DataFrame) -> DataFrame:
    # Both sides read the same shuffled totals, so the events are scanned once. For that the newest row is taken
    # whole (a struct orders by its first field), and the cut is stated on last_seen rather than on the grouping
    # column ds: a condition on ds would move below the aggregation and make the two sides differ.
    newest = monthly.agg(
        F.max(F.struct("last_seen", *[c for c in monthly.columns if c != "last_seen"])).alias("newest")
    )
    last_seen = F.col("newest.last_seen")
    first_cut = F.when(last_seen == F.last_day(last_seen), F.add_months(month_start(last_seen), 1)).otherwise(
        month_start(last_seen)
    )
    return monthly.where(month_start(F.col("last_seen")) < newest.select(first_cut).scalar())


def _series_id(key_cols: Sequence[str]) -> Column:
    """The key as one string. Several columns are joined by ``|``; that sign, the backslash and NULL are escaped."""

    def escaped(name: str) -> Column:
        text = F.replace(F.col(name).cast("string"), F.lit("\\"), F.lit("\\\\"))
        if len(key_cols) > 1:
            text = F.replace(text, F.lit("|"), F.lit("\\|"))
        return F.coalesce(text, F.lit("\\N"))

    return F.concat_ws("|", *[escaped(name) for name in key_cols])
