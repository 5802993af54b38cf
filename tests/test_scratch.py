"""Scratch tables in a session without any setting, and their deletion."""

import os
import subprocess
import sys

from loomspark import scratch

PLAIN = """
import os, tempfile
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from loomspark import scratch
with scratch.temporary_tables(spark):
    a = scratch.written(spark.range(5), "five")
    b = scratch.written(spark.range(3), "three")
    scratch.discard(b)
    assert a.count() == 5 and scratch.shared_dir(spark) == os.path.dirname(a._written_at)
    assert not os.path.exists(b._written_at.removeprefix("file://"))
    path = a._written_at.removeprefix("file://")
    assert os.path.exists(path)
assert not os.path.exists(path)
kept = scratch.written(spark.range(2), "two")
assert kept.count() == 2 and os.path.dirname(kept._written_at) == os.path.dirname(a._written_at)
print("done")
"""


def test_a_plain_session_has_a_folder(tmp_path):
    """Without spark.checkpoint.dir in any file of settings."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.pathsep.join(sys.path)}
    got = subprocess.run([sys.executable, "-c", PLAIN], env=env, capture_output=True, text=True, timeout=180)
    assert got.stdout.strip().endswith("done"), got.stderr[-2000:]


def test_tables_go_with_their_context(spark):
    with scratch.temporary_tables(spark):
        outer = scratch.written(spark.range(1), "outer")
        with scratch.temporary_tables(spark):
            inner = scratch.written(spark.range(1), "inner")
        assert outer.count() == 1
    fs = spark._jvm.org.apache.hadoop.fs
    for df in (outer, inner):
        path = fs.Path(df._written_at)
        assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
