"""Session helpers: shipping the package to executors, paths that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: Bytes of rows that go to a Python worker at once; Spark's own 64 MB, in buffers that double, are a large part of a small executor.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()
_local: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="spark-"))
        folder = _local[0]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession) -> None:
    """Bound the batches of texts that tasks hold in the JVM and in Python alike, for this session; a limit that it has already stays."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so workers must be able
    to import the package; on a cluster where it is not installed this is what provides it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="spark-")
    name = os.path.join(folder, os.path.basename(root) + ".zip")
    with zipfile.ZipFile(name, "w") as z:
        for at, dirs, files in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(at, f), os.path.relpath(os.path.join(at, f), os.path.dirname(root)))
    sc.addPyFile(name)
    _shipped.add(sc.applicationId)
