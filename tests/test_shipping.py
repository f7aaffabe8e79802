"""The package reaches Python workers that share no folder with it."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
FOLDER = "/root/testdata/sf0.001"

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", "{REPO}/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
for name in ("q_html_tables", "q_log_tables", "q_match_logs"):
    print(name, entry.queries()[name](spark, "{FOLDER}").count())
"""


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_page_queries_run_from_an_empty_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = dict(line.split() for line in done.stdout.splitlines() if line.startswith("q_"))
    assert counts == {"q_html_tables": "13500", "q_log_tables": "1500", "q_match_logs": "1495"}
