"""A stock session: no checkpoint folder is preset, and none is left behind."""

import glob
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
tempfile.tempdir = sys.argv[2]
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from sliceforge.session import materialize, ship_package
ship_package(spark)
df = materialize(spark.range(5), "numbers")
print("ROWS", df.count(), df.inputFiles()[0])
"""


def test_start_without_a_preset_folder(tmp_path):
    args = [sys.executable, "-c", SCRIPT, ROOT, str(tmp_path)]
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}  # no defaults of this machine
    out = subprocess.run(args, capture_output=True, text=True, timeout=180, env=env)
    assert out.returncode == 0, out.stderr[-2000:]
    assert "ROWS 5" in out.stdout and str(tmp_path) in out.stdout
    assert not glob.glob(f"{tmp_path}/**/numbers-*", recursive=True)
