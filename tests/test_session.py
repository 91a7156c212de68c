import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_queries_run_from_any_folder_without_a_checkpoint_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
import __spark_entry__ as e
q = e.queries()
print('ROWS', *(q[n](spark, '/root/testdata/sf0.001').count() for n in ('q3_three_way_join', 'stream_dedup', 'op9_quality_classifier', 'op10_substring_dedup') if n in q))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = done.stdout.split("ROWS")[-1].split()
    assert done.returncode == 0 and rows and int(rows[0]) > 0, done.stderr[-2000:]
