"""Executors need no installed copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry

spark = (
    SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", "file://" + {shared!r}).config("spark.driver.memory", "3g").getOrCreate()
)

def known(_):
    import importlib.util
    yield importlib.util.find_spec("corvane") is not None

assert spark.sparkContext.parallelize([0], 1).mapPartitions(known).collect() == [False]
for name in {names!r}:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
NAMES = ["op1_url_filter", "op2_decontaminate", "op3_language_model", "op4_simhash", "op5_toxicity", "op6_quality", "op7_exact_dedup", "op8_token_counts", "op10_token_shards", "op11_filter_audit", "op12_chat_format", "op13_periodic_runs"]


def test_queries_on_workers_without_the_package(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(repo=str(REPO), shared=str(tmp_path), names=NAMES))
    ran = subprocess.run([sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=600, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
