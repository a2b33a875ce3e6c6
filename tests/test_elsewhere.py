"""Python that runs inside tasks must not need basin installed on the workers: run the operators that
use pandas in tasks from another working directory, with only the driver's sys.path pointing here."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
import __spark_entry__ as E
print("rows", E.queries()["window_session"](spark, "/root/testdata/sf0.001").count())
print("entry", E.entry(spark).count())
spark.stop()
"""


def test_worker_side_python_ships_by_value():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tempfile.gettempdir(), env=env,
                         capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "rows " in out.stdout and "entry " in out.stdout
