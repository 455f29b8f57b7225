from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from monthloom.operators.metrics import forecast_payload, forecast_summary, leaderboard, score, unpaired
from monthloom.sources.store import read_metrics, read_metrics_document, write_metrics
from tests.conftest import month

FORECAST = "series_id string, model string, ds date, step int, yhat double"


@pytest.fixture(scope="module")
def forecasts(spark):
    def build(values):
        return spark.createDataFrame(
            [(s, m, month(i), i + 1, float(v)) for (s, m), vs in values.items() for i, v in enumerate(vs)], FORECAST
        )

    return build


def by_model(frame):
    return {(r.series_id, r.model): r for r in frame.collect()}


def test_zero_actuals_count_for_two_of_three(make_panel, forecasts):
    actual = make_panel({"a": [0, 10, 20], "z": [0, 0, 0]})
    got = by_model(score(actual, forecasts({("a", "M"): [3, 11, 16], ("z", "M"): [1, 1, 1]})))
    assert (got["a", "M"].mae, got["a", "M"].rmse, got["a", "M"].mape) == (2.67, 2.94, 15.0)
    assert (got["z", "M"].mae, got["z", "M"].mape) == (1.0, None)


def test_unpaired_months_are_reported(make_panel, forecasts):
    actual = make_panel({"a": [1, 2], "b": [5]})
    rows = unpaired(actual, forecasts({("a", "M"): [1, 2, 3]})).collect()
    assert {(r.series_id, r.ds, r.model, r.has_only) for r in rows} == {
        ("a", month(2), "M", "forecast"), ("b", month(0), None, "actual"),
    }


def test_leaderboard_breaks_ties_by_name_and_puts_unknown_last(spark):
    rows = [("a", "N", 1.5, 2.4, 7.0), ("a", "M", 1.0, 1.0, 7.0), ("a", "O", 9.0, 9.0, 8.0), ("b", "M", 1.0, 1.0, None), ("b", "N", 1.0, 1.0, 50.0)]
    got = by_model(leaderboard(spark.createDataFrame(rows, "series_id string, model string, mae double, rmse double, mape double")))
    assert {k for k, r in got.items() if r.status == "Best"} == {("a", "M"), ("b", "N")}
    assert (got["a", "N"].mae, got["a", "N"].rmse) == (2, 2)


def test_lead_model_of_a_summary(forecasts):
    frame = forecasts({("a", "MLP"): [1, 2], ("a", "SARIMA"): [10, 20], ("b", "Linear Regression"): [4, 4], ("b", "Holt-Winters"): [5, 6], ("c", "Other"): [7, 1]})
    got = {tuple(r) for r in forecast_summary(frame.withColumn("yhat", F.col("yhat").cast("bigint"))).collect()}
    assert got == {("a", "SARIMA", 10, 30), ("b", "Holt-Winters", 5, 11), ("c", "Other", 7, 8)}


def test_payload_has_parallel_arrays(forecasts):
    row = forecast_payload(forecasts({("a", "M"): [1, 2], ("a", "N"): [3, 4]})).first()
    assert row.predictions["N"].months == ["2000-01", "2000-02"] and row.predictions["N"].arrivals == [3.0, 4.0]


def test_metrics_survive_json(spark, make_panel, forecasts, tmp_path):
    metrics = score(make_panel({"a": [5, 10], "b": [0, 0]}), forecasts({("a", "M"): [4, 9], ("a", "N"): [5, 5], ("b", "M"): [1, 1]}))
    write_metrics(metrics, str(tmp_path / "m"))
    assert sorted(map(str, read_metrics(spark, str(tmp_path / "m")).collect())) == sorted(map(str, metrics.collect()))
    with pytest.raises(FileNotFoundError):
        read_metrics(spark, str(tmp_path / "absent"))


def test_metrics_of_one_document(spark, tmp_path):
    path = tmp_path / "results.json"
    path.write_text(json.dumps({"M": {"MAE": 1.5, "RMSE": 2, "MAPE": 3.25}, "N": {"MAE": 1, "RMSE": 1, "MAPE": 1}}, indent=2))
    got = by_model(read_metrics_document(spark, str(path)))
    assert (got["all", "M"].mae, got["all", "M"].rmse, got["all", "M"].mape) == (1.5, 2.0, 3.25)
    assert len(got) == 2
