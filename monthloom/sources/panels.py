"""Panels from files: a monthly CSV table, and event tables in Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from monthloom.operators.rollup import Lookup, dense_months, monthly_panel, with_calendar


def read_monthly_csv(
    spark: SparkSession,
    path: str,
    series_id: str = "all",
    date_format: str = "M/d/yyyy",
    value_col: str | None = None,
    fill_months: bool = False,
) -> DataFrame:
    """A CSV whose header names ``date`` and a column of values, in any order, as a panel of one series.

    Without ``value_col`` the values are the one column besides date, year and month. An empty value stays NULL; text
    that is no whole number or no date fails the job. ``fill_months`` adds the months that the file leaves out, as 0. A
    missing path or column fails when the frame is built, not when it is first used.
    """
    rows = spark.read.option("header", True).csv(path)
    others = [c for c in rows.columns if c not in ("date", "year", "month")]
    if value_col is None and len(others) != 1:
        raise ValueError(f"Name the column of values; the file has {others}.")
    date, value = (F.col(f"`{c}`") for c in ("date", value_col or others[0]))
    ds, y = F.try_to_timestamp(date, F.lit(date_format)).cast("date"), value.try_cast("bigint")
    panel = rows.select(
        F.lit(series_id).alias("series_id"), _read_whole(date, ds, "date").alias("ds"), _read_whole(value, y, "value").alias("y")
    )
    return dense_months(panel) if fill_months else with_calendar(panel)


def _read_whole(text: Column, read: Column, what: str) -> Column:
    """``read``, but an error where ``text`` is there and could not be read."""
    failed = F.raise_error(F.concat(F.lit(f"This is no {what}: "), text))
    return F.when(text.isNotNull() & read.isNull(), failed).otherwise(read)


# Columns read from each table. A declared schema spares a job per table that would look it up in the files.
_TABLES = {
    "orders": "o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "lineitem": "l_partkey BIGINT, l_suppkey BIGINT, l_quantity DOUBLE, l_shipdate TIMESTAMP_NTZ",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def order_panel(spark: SparkSession, folder: str, by: str = "n_name") -> DataFrame:
    """Orders per month for each nation (``by='n_name'``), region (``'r_name'``) or market segment."""
    chain = [("customer", "o_custkey", "c_custkey")]
    if by in ("n_name", "r_name"):
        chain.append(("nation", "c_nationkey", "n_nationkey"))
    if by == "r_name":
        chain.append(("region", "n_regionkey", "r_regionkey"))
    lookups = [Lookup(read_table(spark, folder, name), left, right) for name, left, right in chain]
    return monthly_panel(read_table(spark, folder, "orders"), "o_orderdate", [by], lookups=lookups)


def shipment_panel(spark: SparkSession, folder: str, key: str = "l_suppkey") -> DataFrame:
    """Quantity shipped per month for each supplier or part."""
    lineitem = read_table(spark, folder, "lineitem")
    return monthly_panel(lineitem, "l_shipdate", [key], value_col="l_quantity")
