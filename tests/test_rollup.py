from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from monthloom.operators.rollup import Lookup, monthly_panel
from monthloom.sources.panels import read_monthly_csv


def events(spark, rows):
    return spark.createDataFrame([(k, dt.datetime.fromisoformat(t), v) for k, t, v in rows], "k string, ts timestamp_ntz, v double")


ROWS = [
    ("a", "2020-01-05T10:00:00", 1.5),
    ("a", "2020-01-31T23:59:59", 2.0),
    ("a", "2020-04-01T00:00:00", 4.0),
    ("b", "2020-03-15T12:00:00", 8.0),
    ("b", "2020-05-02T12:00:00", 16.0),
]


def values(panel):
    return [(r.series_id, r.ds.isoformat()[:7], r.y) for r in panel.orderBy("series_id", "ds").collect()]


def test_counts_fills_and_cuts(spark):
    panel = monthly_panel(events(spark, ROWS), "ts", ["k"])
    assert panel.columns == ["series_id", "ds", "y", "year", "month"]
    assert values(panel) == [
        ("a", "2020-01", 2), ("a", "2020-02", 0), ("a", "2020-03", 0), ("a", "2020-04", 1), ("b", "2020-03", 1),
    ]


def test_sums_and_keeps_the_last_month(spark):
    panel = monthly_panel(events(spark, ROWS), "ts", ["k"], value_col="v", cut_partial=False)
    assert values(panel)[-3:] == [("b", "2020-03", 8.0), ("b", "2020-04", 0.0), ("b", "2020-05", 16.0)]


def test_a_month_seen_to_its_last_day_is_whole(spark):
    rows = [*ROWS, ("b", "2020-05-31T00:00:00", 1.0)]
    assert ("b", "2020-05", 2) in values(monthly_panel(events(spark, rows), "ts", ["k"]))


def test_events_without_a_time_are_left_out(spark):
    rows = events(spark, ROWS).unionByName(
        spark.createDataFrame([("a", None, 1.0)], "k string, ts timestamp_ntz, v double")
    )
    assert sum(v for _, _, v in values(monthly_panel(rows, "ts", ["k"]))) == 4


def test_keys_of_several_columns_do_not_run_together(spark):
    at = dt.datetime(2020, 1, 31)
    rows = [("a|b", "c", at), ("a", "b|c", at), ("a\\", "|c", at), (None, "c", at), ("\\N", "c", at), ("", "c", at)]
    frame = spark.createDataFrame(rows, "k string, l string, ts timestamp_ntz")
    panel = monthly_panel(frame, "ts", ["k", "l"])
    assert panel.select("series_id").distinct().count() == len(rows)
    assert panel.where("y = 1").count() == len(rows)


def test_a_large_lookup_gives_the_same_even_with_a_hot_key(spark):
    # One customer holds more than a third of all events.
    stamp = F.expr("timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(id % 700)")
    rows = spark.range(6000).select(F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 97).alias("c"), stamp.alias("ts"))
    people = spark.range(97).select(F.col("id").alias("pid"), (F.col("id") % 3).cast("int").alias("g"))

    def run():
        return monthly_panel(rows, "ts", ["g"], lookups=[Lookup(people, "c", "pid")], cut_partial=False)

    small = values(run())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = run()
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan
        assert values(large) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(v for _, _, v in small) == 6000


def test_the_events_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "events")
    events(spark, ROWS).write.parquet(path)
    panel = monthly_panel(spark.read.parquet(path), "ts", ["k"])
    panel.collect()
    plan = panel._jdf.queryExecution().executedPlan().toString()
    # The search for the newest month takes over the shuffled totals.
    assert "ReusedExchange [k" in plan
    assert "FileScan parquet [k" in plan and "ReadSchema: struct<k:string,ts:timestamp_ntz>" in plan


def test_csv(spark, tmp_path):
    path = tmp_path / "monthly.csv"
    path.write_text("date,visitors,year,month\n1/1/1991,17917,1991,1\n12/1/1991,15,1991,12\n")
    panel = read_monthly_csv(spark, str(path))
    assert [tuple(r) for r in panel.orderBy("ds").collect()] == [
        ("all", dt.date(1991, 1, 1), 17917, 1991, 1),
        ("all", dt.date(1991, 12, 1), 15, 1991, 12),
    ]
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_monthly_csv(spark, str(tmp_path / "absent.csv"))


def test_csv_columns_go_by_name_and_bad_text_fails(spark, tmp_path):
    def read(text, **kwargs):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text(text)
        return read_monthly_csv(spark, str(path), **kwargs)

    other_order = read("year,month,date,visitors\n1991,1,1/1/1991,17917\n1991,3,3/1/1991,\n")
    assert [(r.ds, r.y) for r in other_order.orderBy("ds").collect()] == [(dt.date(1991, 1, 1), 17917), (dt.date(1991, 3, 1), None)]
    two = "date,a,b.c\n1/1/1991,1,2\n3/1/1991,3,4\n"
    assert [r.y for r in read(two, value_col="b.c", fill_months=True).orderBy("ds").collect()] == [2, 0, 4]
    with pytest.raises(ValueError, match="Name the column"):
        read(two)
    for bad in ("date,visitors\n1/1/1991,12x\n", "date,visitors\n1991-01,12\n"):
        with pytest.raises(Exception, match="This is no"):
            read(bad).collect()
