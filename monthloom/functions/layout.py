"""The one layout all windows share: rows of a series together, in order of month.

Windows over the same layout follow each other without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql.window import WindowSpec


def by_series() -> WindowSpec:
    return Window.partitionBy("series_id")


def in_order() -> WindowSpec:
    return by_series().orderBy("ds")
