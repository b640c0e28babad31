"""Readies a session: the package's source on the executors, small Arrow batches, a shared folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows and bytes of an Arrow batch. Long texts make batches of the default 10,000 rows
#: take hundreds of MB in each task, twice: in the JVM and in its Python worker.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    # Shuffle files of an ended action go at once; what is used again is written out first.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def ship(spark: SparkSession) -> None:
    """Sends the package's source to the executors, once for each application.

    Functions that run in Python workers are pickled by reference, so the workers must be
    able to import this package; ``addPyFile`` gives it to present and later executors.
    SETTINGS are set on the session and stay set.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "quillspark_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, f"{root.name}/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


#: Where tables go on a local master that names no folder.
LOCAL_DIR = "file:///tmp/checkpoints"
_homes: dict[str, str] = {}


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names (or setCheckpointDir() was
    given), which the driver and all executors share. Where neither is set, a local master gets a
    local folder and any other is an error: executors would write to disks of their own. Each
    application has a folder of its own there, which goes when its driver ends."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_DIR
    key = f"{context.applicationId} {base}"
    if key not in _homes:
        path = f"{base.rstrip('/')}/{context.applicationId}"
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
        _homes[key] = path
    return f"{_homes[key]}/{tag}-{uuid.uuid4().hex[:12]}"
