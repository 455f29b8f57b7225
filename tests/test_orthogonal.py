"""Least squares by mergeable triangular factors: merges equal one reduction, large means lose no digits."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from monthloom.operators.orthogonal import fit_linear_orthogonal, merge, reduce_block, solve


def test_merged_factors_equal_one_reduction():
    rng = np.random.default_rng(1)
    block = rng.standard_normal((300, 4)) * [1, 10, 100, 1] + [5, -3, 1e6, 2]
    whole = reduce_block(block)
    parts = [reduce_block(block[a:b]) for a, b in ((0, 7), (7, 8), (8, 150), (150, 300))]
    merged = merge(parts)
    assert merged[0] == 300 and np.allclose(merged[1], whole[1])
    # Factors are unique up to the signs of their rows.
    assert np.allclose(np.abs(merged[2]), np.abs(whole[2]), rtol=1e-9, atol=1e-6)
    assert np.allclose(solve(*merged)[0], solve(*whole)[0], rtol=1e-9)


def test_columns_with_large_means_keep_their_digits():
    rng = np.random.default_rng(2)
    x = 1e9 + rng.integers(-1, 2, 500).astype(float)
    f = rng.standard_normal(500)
    y = 3 + 2 * (x - 1e9) + 5 * f
    parts = [reduce_block(np.c_[x[i : i + 50], f[i : i + 50], y[i : i + 50]]) for i in range(0, 500, 50)]
    coefficients, sse = solve(*merge(parts))
    # y = (3 - 2e9) + 2 x + 5 f exactly. Means of 1e9 carry rounding of about 1e-7 into the merge; sums of squares
    # of the raw columns put the intercept off by about 1e5 here.
    assert coefficients[1:] == pytest.approx([2.0, 5.0], rel=1e-7)
    assert coefficients[0] == pytest.approx(3 - 2e9, abs=50)
    assert sse == pytest.approx(0.0, abs=1e-6)


def test_rank_deficient_columns_get_zero():
    x = np.arange(20.0)
    coefficients, _ = solve(*reduce_block(np.c_[x, 2 * x, 1 + 3 * x]))
    assert coefficients[0] == pytest.approx(1.0) and coefficients[1] + 2 * coefficients[2] == pytest.approx(3.0)


def test_spark_fit_statuses_and_a_series_over_many_partitions(spark):
    def month(i: int) -> dt.date:
        return dt.date(2000 + i // 12, i % 12 + 1, 1)

    rows = [("hot", month(i), float(i), 1e9 + i % 3, 7.0 + 0.5 * i - 2 * (i % 3)) for i in range(3000)]
    rows += [("short", month(0), 1.0, 1e9, 2.0), ("gap", month(0), None, 1e9, 1.0), ("gap", month(1), 2.0, 1e9 + 1, 3.0)]
    rows += [("gap", month(i), float(i), 1e9 + i % 2, float(i)) for i in range(2, 10)]
    train = spark.createDataFrame(rows, "series_id string, ds date, a double, b double, y double").repartition(13)
    fitted = {r.series_id: r for r in fit_linear_orthogonal(train, ["a", "b"], "y", fan_in=4).collect()}
    assert {k: r.status for k, r in fitted.items()} == {"hot": "ok", "short": "too_short", "gap": "missing_values"}
    params = fitted["hot"].params
    assert params["a"] == pytest.approx(0.5, rel=1e-7) and params["b"] == pytest.approx(-2.0, rel=1e-7)
    assert params["intercept"] == pytest.approx(7.0 + 2e9, abs=50)
    assert fitted["hot"].train_end == month(2999)
