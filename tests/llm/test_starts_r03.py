"""What writing a table to the shared folder starts: Hadoop's local file system runs ``chmod`` for what it makes, and a process that has just been started
shares the JVM's whole memory."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from rasterloom.shipping import stored

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
from pyspark.sql import SparkSession
from rasterloom.shipping import stored
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[1]).config("spark.checkpoint.dir", "file://" + sys.argv[1] + "/shared").getOrCreate()
assert stored(s.range(0, 1000, 1, 8)).count() == 1000
"""


def test_a_task_starts_two_processes_at_most(tmp_path):
    own = tmp_path / "chmod"
    own.write_text('#!/bin/sh\necho "$*" >> "$STARTED"\nexec /bin/chmod "$@"\n')
    own.chmod(0o755)
    env = os.environ | {"PATH": f"{tmp_path}:{os.environ['PATH']}", "STARTED": str(tmp_path / "started"), "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], env=env, check=True, timeout=120, capture_output=True)
    started = [x for x in (tmp_path / "started").read_text().splitlines() if "/attempt_" in x]
    assert len(started) == 16 and sum(x.endswith(".parquet") for x in started) == 8  # for each of 8 tasks its folder and its file


def test_a_damaged_table_is_an_error(spark):
    df = stored(spark.range(0, 100_000, 1, 2), "damaged")
    assert df.agg({"id": "sum"}).first()[0] == 99_999 * 50_000
    file = Path(df.inputFiles()[0].removeprefix("file://"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match=r"(?i)checksum|crc"):
        df.agg({"id": "sum"}).first()
