"""Sends this package's sources to the executors' Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: For tables in a shared folder that is mounted as a local path; other schemes don't look at it. Hadoop's local file system starts ``chmod`` for each folder and
#: file, and what has just been started shares the JVM's whole memory. Without ``.crc`` files a task starts two, not three; Parquet's own checksums stand for them.
WRITING = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true", "parquet.page.write-checksum.enabled": "true"}
READING = {"parquet.page.verify-checksum.enabled": "true"}


def ship(spark: SparkSession) -> None:
    """Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rasterloom-")) / "rasterloom_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where none is named, as in tests, a temporary one of our own, but only if
    driver and executors are one process: on a cluster others could not see it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="rasterloom-"))
    return (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def light(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` hinted for broadcast if it has at most ``rows`` rows (narrow ones: some MB), else as it is. It should be cheap to count, as a checkpoint is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def stored(df: DataFrame, label: str = "stored") -> DataFrame:
    """``df`` written to the shared folder and read again. Unlike a checkpoint this forgets what the optimizer has inferred of the columns: over rounds of
    conditional columns that knowledge grows by a factor each round, and planning takes longer than the work."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**WRITING).parquet(path)
    return df.sparkSession.read.options(**READING).schema(df.schema).parquet(path)
