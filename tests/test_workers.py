"""Python workers need no copy of the package: the entry point works from any folder in a plain session."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4").getOrCreate()
)
for name in ("ols_fit", "hw_fit", "sarima_fit", "mlp_forward_batched", "mlp_gradient"):
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").collect(), name
print("all done")
"""


def test_from_another_folder(tmp_path):
    entry = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    command = [sys.executable, "-c", SCRIPT, str(entry)]
    run = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "all done" in run.stdout, run.stderr[-2000:]
