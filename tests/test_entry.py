"""The driver contract, from a folder where executors cannot import the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert set(entry.oracle_sql()) <= set(entry.queries())
from wattshelf.functions.text import clean_text
row = spark.createDataFrame([("Tea &amp; cake",)], "x string").select(clean_text(F.col("x")).alias("y")).first()
assert row["y"] == "tea cake", row
"""


def test_python_functions_reach_the_workers(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
