"""Time the headline queries on a local session and print one JSON line.

Each query runs once to warm up (code generation, Python workers) and is then timed once, from building the plan to
having computed every row.
"""

from __future__ import annotations

import importlib.util
import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE))

from monthloom.session import local_session  # noqa: E402

HEADLINE = (
    "monthly_panel", "shipment_panel", "history_records", "monthly_average", "season_average", "history_meta",
    "history_summary", "features", "train_test_split", "seasonal_difference", "feature_scaler", "zscore_transform",
    "ols_fit2", "ols_fit", "future_features", "hw_forecast_fixed", "hw_fit", "hw_fit_shipments", "sarma_filter_fixed",
    "sarima_fit", "sarima_fit_shipments", "ols_raw", "arma_likelihood_fixed", "sarima_mle",
    "mlp_forward_batched", "mlp_gradient", "mlp_train", "forecast_metrics", "leaderboard",
    "backtest_all", "forecast_all",
)


def main() -> None:
    spec = importlib.util.spec_from_file_location("spark_entry", HERE / "__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = entry.queries(), {}
    wanted = sys.argv[1:] or HEADLINE
    for name in wanted:
        for _ in range(2):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
