import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT, DATA = Path(__file__).parents[2], "/root/testdata/sf0.001"

CODE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
known = e.queries()
assert known and set(e.oracle_sql()) <= set(known) and not any(k.startswith("op") or k == "pipeline" for k in known)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert known["symbol_count"](spark, "%s").count() > 0
print("works")
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("pipeline", [True, False])
def test_the_rest_works_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "tree")}
    done = subprocess.run([sys.executable, "-c", CODE % DATA], cwd=tmp_path / "tree", env=env, capture_output=True, text=True, timeout=300)
    assert "works" in done.stdout, done.stderr[-2000:]
