"""Column expressions over a month's date: labels, seasons, cyclic encodings and flags."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.config import PanelConfig


def month_start(ts: Column) -> Column:
    """First day of the month of a date or timestamp."""
    return F.trunc(ts.cast("date"), "MM")


def month_name(ds: Column) -> Column:
    return F.date_format(ds, "MMM")


def date_label(ds: Column) -> Column:
    return F.date_format(ds, "yyyy-MM")


def season_label(month: Column, cfg: PanelConfig) -> Column:
    label = F.lit(cfg.default_season)
    for season, months in cfg.season_months.items():
        label = F.when(month.isin(*months), F.lit(season)).otherwise(label)
    return label


def month_sin(month: Column) -> Column:
    return F.sin(month * F.lit(2 * math.pi / 12))


def month_cos(month: Column) -> Column:
    return F.cos(month * F.lit(2 * math.pi / 12))


def flag(value: Column, members: Iterable[int]) -> Column:
    """1 where ``value`` is one of ``members``, else 0."""
    members = tuple(members)
    return value.isin(*members).cast("int") if members else F.lit(0)


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months from ``earlier`` to ``later``, both on the first of a month."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")
