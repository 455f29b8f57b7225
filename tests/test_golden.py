"""Known results of one monthly CSV table; set MONTHLOOM_GOLDEN_CSV to its path to run them."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from monthloom.config import HOLT_WINTERS, LINEAR, MLP, SARIMA, PanelConfig
from monthloom.operators.features import add_features, future_features, split_by_time
from monthloom.operators.history import history
from monthloom.operators.metrics import score
from monthloom.operators.scaling import fit_scaler
from monthloom.plans.training import evaluate_models
from monthloom.sources.panels import read_monthly_csv

PATH = os.environ.get("MONTHLOOM_GOLDEN_CSV")
pytestmark = pytest.mark.skipif(not PATH, reason="MONTHLOOM_GOLDEN_CSV is not set")


@pytest.fixture(scope="module")
def panel(spark):
    return read_monthly_csv(spark, PATH).cache()


def test_table(panel):
    row = panel.agg(F.count("y"), F.min("y"), F.max("y"), F.sum("y")).first()
    assert tuple(row) == (423, 13030, 147859, 22110948)


def test_history(panel):
    answer = history(panel, 2016, 2026)
    assert answer.records.count() == 123
    assert [(r.season, r.average_arrivals) for r in answer.season_average.collect()] == [
        ("autumn_trek", 100081.13), ("spring_trek", 87333.61), ("shoulder", 77891.84), ("monsoon", 65319.40),
    ]
    assert [r.average_arrivals for r in answer.monthly_average.collect()] == [
        64760.27, 80625.73, 99873.82, 90617.90, 70255.10, 62666.00,
        59926.90, 73365.30, 79159.90, 114649.70, 106433.80, 89329.30,
    ]
    assert history(panel, 2016, 2026, "monsoon").records.count() == 30
    assert [r.average_arrivals for r in history(panel).season_average.collect()] == [63796.75, 54491.78, 48670.17, 42175.73]


def test_features_and_scaler(panel):
    rows = add_features(panel).orderBy("ds").collect()
    assert len(rows) == 411
    assert (rows[0].y, rows[0].lag_1, rows[0].lag_3, rows[0].lag_12) == (17451, 26031, 39339, 17917)
    assert (rows[-1].y, rows[-1].lag_1, rows[-1].lag_3, rows[-1].lag_12) == (120516, 105441, 98190, 121687)
    train = split_by_time(add_features(panel)).where("split = 'train'")
    got = {r["column"]: (round(r["mean"], 7), round(r["std"], 7)) for r in fit_scaler(train).collect()}
    assert got["y"] == (51708.6666667, 26580.6520359)
    assert got["lag_1"] == (51468.9273183, 26379.0252803)
    assert got["lag_3"] == (51202.4937343, 26261.3266991)
    assert got["lag_12"] == (49639.4837093, 25754.7973157)


def test_future(panel):
    rows = future_features(add_features(panel), 12).orderBy("step").collect()
    assert {r.lag_1 for r in rows} == {120516.0} and {r.year_norm for r in rows} == {1.0} and {r.is_covid for r in rows} == {0}
    assert [r.lag_3 for r in rows[:4]] == [92573.0, 105441.0, 120516.0, 120516.0]
    assert (rows[0].lag_12, rows[-1].lag_12) == (106599.0, 120516.0)


def test_accuracy_on_the_held_out_year(panel):
    cut = panel.where("ds <= '2026-02-01'")
    got = {r.model: r for r in evaluate_models(cut, PanelConfig()).metrics.collect()}
    assert (got[LINEAR].mae, got[LINEAR].rmse, got[LINEAR].mape) == (8380.91, 9498.27, 8.50)
    assert got[HOLT_WINTERS].mape <= 7.52
    assert got[SARIMA].mape <= 6.75
    assert got[MLP].mape <= 8.88
    naive = add_features(cut).withColumns({"model": F.lit("naive"), "yhat": F.col("lag_12")})
    test = split_by_time(naive).where("split = 'test'")
    row = score(test, test.drop("y")).first()
    assert (row.mae, row.rmse, row.mape) == (8479.50, 10031.88, 8.84)
