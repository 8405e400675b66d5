"""Tasks find the package although the driver runs elsewhere and only its own path names it."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from timbrel.operators import intervals
from timbrel.session import ship
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
ship(spark)
ship(spark)
df = spark.createDataFrame([(1, 0, 5), (1, 7, 9)], "entity int, start_ms bigint, end_ms bigint")
print("GAPS", [tuple(r) for r in intervals.gaps(intervals.interval_state(df)).collect()])
"""


def test_package_reaches_the_tasks(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE, repo, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GAPS [(1, 5, 7)]" in out.stdout, out.stderr[-2000:]
