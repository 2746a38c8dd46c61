"""Workers of a session started elsewhere, without the package on their path, can import it once it is sent."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from rivulet.ship import ship
from rivulet.operators import folds
rows = ship(ship(spark)).createDataFrame([(1, 0.0, 5), (1, 1.0, 6)], "job_id long, t double, x int")
print("found", [r.x for r in folds.fold(rows, "job_id", ["t"], folds.merged_holds, "job_id long, t double, x int").collect()])
"""


def test_ship(tmp_path):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=ROOT)], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert "found [5, 5]" in done.stdout, done.stderr[-2000:]
