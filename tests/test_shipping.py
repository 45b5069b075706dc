import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from structlens.operators.outline import region_ends
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
rows = spark.createDataFrame([("a", 1, 0, 9), ("a", 3, 1, 9), ("a", 5, 0, 9)], "file_path string, line_no int, depth int, last_line int")
print("ENDS", sorted((r.line_no, r.line_end) for r in region_ends(rows).collect()))
spark.stop()
"""


def test_workers_get_the_package_where_their_path_lacks_it(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "ENDS [(1, 4), (3, 4), (5, 9)]" in done.stdout, done.stderr[-2000:]
