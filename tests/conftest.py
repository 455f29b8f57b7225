from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__  # noqa: E402, F401  (ships the package to Python workers)
from monthloom.operators.rollup import with_calendar  # noqa: E402
from monthloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def month(offset: int, start: tuple[int, int] = (2000, 1)) -> dt.date:
    index = start[0] * 12 + start[1] - 1 + offset
    return dt.date(index // 12, index % 12 + 1, 1)


@pytest.fixture(scope="session")
def make_panel(spark):
    """Build a panel from ``{series: values}``, one value per month from a start month."""

    def build(series: dict[str, list], start: tuple[int, int] = (2000, 1)):
        rows = [(name, month(i, start), v) for name, values in series.items() for i, v in enumerate(values)]
        kind = "double" if any(isinstance(r[2], float) for r in rows) else "bigint"
        return with_calendar(spark.createDataFrame(rows, f"series_id string, ds date, y {kind}"))

    return build
