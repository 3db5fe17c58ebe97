"""The driver builds its own session in its own working directory: the
queries must not depend on get_session() or on the repository being the
current directory (pandas kernels run in Python workers)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() > 0
h = E.queries()["a6_distance_histogram"](spark, "/root/testdata/sf0.001")
assert h.count() > 0
print("FOREIGN_OK")
"""


def test_queries_run_in_a_plain_session_elsewhere():
    cwd = tempfile.mkdtemp(prefix="moodgrid-foreign-")
    env = dict(os.environ)
    env.pop("PYTHONPATH", None)
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "FOREIGN_OK" in out.stdout, out.stderr[-2000:]
