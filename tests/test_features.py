from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from monthloom.config import FEATURE_COLS, PanelConfig
from monthloom.operators.features import (
    add_features, future_features, seasonal_difference, series_arrays, split_by_time, too_short,
)
from monthloom.operators.metrics import as_counts
from monthloom.operators.scaling import apply_scaler, fit_scaler, standardise, unscale
from tests.conftest import month


def test_features_of_a_known_series(make_panel):
    rows = add_features(make_panel({"a": list(range(100, 130))}, start=(2019, 1))).orderBy("ds").collect()
    assert len(rows) == 18
    first = rows[0]
    assert (first.ds, first.lag_1, first.lag_3, first.lag_12) == (month(12, (2019, 1)), 111.0, 109.0, 100.0)
    assert first.year_norm == 0.5 and rows[-1].year_norm == 1.0
    assert [r.is_covid for r in rows] == [1] * 18
    june = rows[5]
    assert abs(june.month_sin) < 1e-9 and june.month_cos == -1.0
    assert (june.is_spring_trek, june.is_autumn_trek, june.is_monsoon) == (0, 0, 1)


def test_anomaly_years_are_a_parameter(make_panel):
    rows = add_features(make_panel({"a": list(range(30))}), PanelConfig(anomaly_years=(2002,)))
    assert {(r.year, r.is_covid) for r in rows.collect()} == {(2001, 0), (2002, 1)}


def test_rows_with_a_missing_lag_are_dropped(make_panel):
    values = list(range(40))
    values[20] = None
    kept = {r.ds for r in add_features(make_panel({"a": values})).collect()}
    assert kept == {month(i) for i in range(12, 40)} - {month(21), month(23), month(32)}


def test_one_year_has_year_norm_zero(make_panel):
    panel = make_panel({"a": list(range(12))})
    future = future_features(panel, 1).first()
    assert future.year_norm == 1.0  # the next month is in the next year
    inside = future_features(make_panel({"a": [1, 2]}), 3)
    assert {r.year_norm for r in inside.collect()} == {0.0}


def test_split_is_by_time_and_whole(make_panel):
    split = split_by_time(add_features(make_panel({"a": list(range(40)), "b": list(range(24)), "c": list(range(25))})))
    rows = split.orderBy("ds").collect()
    assert {r.series_id for r in rows} == {"a", "c"}
    for name, train in (("a", 16), ("c", 1)):
        parts = [r.split for r in rows if r.series_id == name]
        assert parts == ["train"] * train + ["test"] * 12


def test_short_series_are_listed(make_panel):
    panel = make_panel({"a": list(range(40)), "b": list(range(24)), "c": list(range(25))})
    assert [tuple(r) for r in too_short(panel).collect()] == [("b", 24)]


def test_one_shuffle_for_features_split_and_scaling(make_panel):
    plan = standardise(split_by_time(add_features(make_panel({"a": list(range(60))}))))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_future_lags_equal_a_plain_loop(spark, make_panel):
    rng = random.Random(3)
    series = {f"s{n}_{k}": [rng.randint(0, 99) for _ in range(n)] for n in range(1, 16) for k in range(3)}
    got = {(r.series_id, r.step): r for r in future_features(make_panel(series), 12).collect()}
    for name, values in series.items():
        known = list(values)
        for step in range(1, 13):
            row = got[name, step]
            for k in (1, 3, 12):
                assert row[f"lag_{k}"] == (known[-k] if len(known) >= k else 0.0)
            assert row.ds == month(len(values) - 1 + step)
            assert row.is_covid == 0
            known.append(known[-1])


def test_future_frame_has_all_features(make_panel):
    assert set(FEATURE_COLS) <= set(future_features(make_panel({"a": [1, 2, 3]}), 2).columns)


def test_difference_of_trend_and_season_is_zero(make_panel):
    values = [3 * t + (t % 12) ** 2 for t in range(40)]
    rows = seasonal_difference(make_panel({"a": values})).orderBy("ds").collect()
    assert [r.dy for r in rows[:13]] == [None] * 13
    assert {r.dy for r in rows[13:]} == {0.0}


def test_arrays_are_in_order(make_panel):
    row = series_arrays(make_panel({"a": [5, 4, 9]}).orderBy(F.desc("ds")), "y").first()
    assert row.y == [5, 4, 9] and row.ds == [month(0), month(1), month(2)]


def test_scaling_matches_numpy_rules_and_inverts(make_panel):
    rng = random.Random(5)
    panel = make_panel({"a": [rng.randint(0, 500) for _ in range(60)], "flat": [7] * 60})
    split = split_by_time(add_features(panel))
    train = split.where("split = 'train'")
    scaler = {(r.series_id, r["column"]): r for r in fit_scaler(train).collect()}
    lags = [r.lag_12 for r in train.where("series_id = 'a'").collect()]
    mean = sum(lags) / len(lags)
    assert math.isclose(scaler["a", "lag_12"].mean, mean)
    assert math.isclose(scaler["a", "lag_12"].std, math.sqrt(sum((v - mean) ** 2 for v in lags) / len(lags)))
    assert scaler["flat", "y"].std == 1.0 and scaler["flat", "y"].mean == 7.0

    one_pass = {(r.series_id, r.ds): r for r in standardise(split).collect()}
    joined = apply_scaler(split, fit_scaler(train), (*FEATURE_COLS, "y"), keep_target=True)
    for r in joined.withColumn("back", unscale(F.col("z_y"))).collect():
        assert math.isclose(r.back, r.y, abs_tol=1e-9)
        other = one_pass[r.series_id, r.ds]
        assert all(math.isclose(r[f"z_{c}"], other[f"z_{c}"], abs_tol=1e-9) for c in (*FEATURE_COLS, "y"))


def test_counts_round_half_to_even_and_stay_positive(spark):
    frame = spark.createDataFrame([(v,) for v in (2.5, 3.5, -0.4, -7.0, 0.5, 1e6 + 0.6)], "yhat double")
    assert [r.yhat for r in as_counts(frame).collect()] == [2, 4, 0, 0, 0, 1000001]
